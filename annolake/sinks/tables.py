"""Sinks: catalogs, indexes, annotation documents, label text and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolake.operators.splits import map_text
from annolake.presets import CATEGORY_IDS
from annolake.schema import CATALOG, INDEX_COLUMNS
from annolake.session import SPREAD, shuffle_partitions
from annolake.sinks.files import write_large_files, write_named_files

#: Lines of one compressed file at most.
FILE_LINES = 500_000


def csv_ready(df: DataFrame) -> DataFrame:
    """Booleans as 0/1, arrays joined by semicolon, maps as JSON with sorted keys."""
    columns = []
    for field in df.schema:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.BooleanType):
            value = value.cast("int")
        elif isinstance(field.dataType, T.ArrayType):
            value = F.array_join(value.cast("array<string>"), ";")
        elif isinstance(field.dataType, T.MapType):
            value = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value))))
        columns.append(value.alias(field.name))
    return df.select(*columns)


def _write_csv(df: DataFrame, path: str) -> None:
    csv_ready(df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_catalog(df: DataFrame, path: str) -> None:
    """All catalog columns ordered by dataset and sample (K1)."""
    _write_csv(df.select(*CATALOG.fieldNames()).orderBy("dataset_id", "sample_id"), path)


def group_splits(df: DataFrame) -> DataFrame:
    """First split and fold and the sample count of each group (K2)."""
    first = F.min_by(F.struct("dataset_id", "split", "ring_r2_fold"), F.struct("dataset_id", "sample_id"))
    grouped = df.groupBy("group_id").agg(first.alias("_f"), F.count(F.lit(1)).alias("sample_count"))
    return grouped.select(
        F.col("_f.dataset_id").alias("dataset_id"), "group_id", F.col("_f.split").alias("split"),
        F.col("_f.ring_r2_fold").alias("ring_r2_fold"), "sample_count",
    )


def write_group_splits(df: DataFrame, path: str) -> None:
    """Group table ordered by dataset and group (K2)."""
    _write_csv(group_splits(df).orderBy("dataset_id", "group_id"), path)


def _segmentation_json(df: DataFrame) -> Column:
    """JSON text of polygons or run lengths, an empty list without either."""
    result = F.lit("[]")
    if "rle" in df.columns:
        result = F.when(F.col("rle").isNotNull(), F.to_json("rle")).otherwise(result)
    if "polygons" in df.columns:
        result = F.when(F.size(F.coalesce("polygons", F.array().cast("array<array<double>>"))) > 0, F.to_json("polygons")).otherwise(result)
    return result


def _annotation_json(df: DataFrame) -> Column:
    """One annotation as JSON with its segmentation as a real list or object."""
    plain = [c for c in df.columns if c not in ("polygons", "rle", "split")]
    head = F.regexp_replace(F.to_json(F.struct(*plain)), r"\}$", "")
    return F.concat(head, F.lit(',"segmentation":'), _segmentation_json(df), F.lit("}"))


def write_coco_tables(images: DataFrame, annotations: DataFrame, path: str, compression: str = "gzip") -> None:
    """Line-delimited images, annotations and categories partitioned by split (K3).

    This is the form for large sets: no split is ever gathered in one place. The lines repeat their field names, so the files are
    compressed; a file has at most ``FILE_LINES`` lines, as one task reads a compressed file from its start.
    """
    def writer(df: DataFrame) -> DataFrameWriter:
        return df.write.mode("overwrite").partitionBy("split").options(compression=compression, maxRecordsPerFile=FILE_LINES)

    writer(images).json(f"{path}/images")
    writer(annotations.select("split", _annotation_json(annotations).alias("value"))).text(f"{path}/annotations")
    writer(categories_table(images)).json(f"{path}/categories")


def categories_table(images: DataFrame) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(number).alias("id"), F.lit(name).alias("name"), F.lit("wood_defect").alias("supercategory"))
        for name, number in CATEGORY_IDS.items()
    ])
    return images.select("split").distinct().select("split", F.inline(rows))


def coco_document_lines(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Each split's document as ordered lines: put together they are one JSON text (K3).

    Columns split, part, id, line. Lines carry a leading comma unless first of their list. Ids are whole numbers: JSON sets them no
    bound, so decimals may hold those beyond 64 bits.
    """
    wide = any(isinstance(df.schema["id"].dataType, T.DecimalType) for df in (images, annotations))
    kind = T.DecimalType(38, 0) if wide else T.LongType()
    splits = images.select("split").distinct()
    categories = ",".join(
        f'{{"id":{number},"name":"{name}","supercategory":"wood_defect"}}' for name, number in CATEGORY_IDS.items()
    )
    fixed = splits.select("split", F.inline(F.array(*[
        F.struct(F.lit(part).alias("part"), F.lit(-1).cast(kind).alias("id"), F.lit(text).alias("line"))
        for part, text in [
            (0, f'{{"info":{{"description":"Unified defects"}},"licenses":[],"categories":[{categories}],"images":['),
            (2, '],"annotations":['), (4, "]}"),
        ]
    ])))

    def listed(df: DataFrame, part: int, text: Column) -> DataFrame:
        # One row per split, and a split is a folder: sent to the rows, as dealing these by split would give a whole split to one task.
        first = F.broadcast(df.groupBy("split", "id").count().groupBy("split").agg(F.min(F.struct("id", "count")).alias("_first")))
        comma = F.when(F.col("id") != F.col("_first.id"), ",").when(F.col("_first.count") == 1, "").otherwise(
            F.raise_error(F.lit("ids of a COCO document must be unique")))
        return df.join(first, "split").select(
            "split", F.lit(part).alias("part"), F.col("id").cast(kind).alias("id"), F.concat(comma, text).alias("line")
        )

    return fixed.unionByName(listed(images, 1, F.to_json(F.struct(*images.columns)))).unionByName(
        listed(annotations, 3, _annotation_json(annotations))
    )


def write_coco(images: DataFrame, annotations: DataFrame, path: str) -> None:
    """Documents as text parts per split: concatenated in name order they are one JSON file (K3).

    Rows are range sorted, so parts follow each other and no task holds a whole document.
    """
    lines = coco_document_lines(images, annotations)
    order = ["split", "part", "id"]
    lines = lines.repartitionByRange(max(SPREAD, shuffle_partitions(lines)), *order).sortWithinPartitions(*order)
    lines.select("split", "line").write.mode("overwrite").partitionBy("split").text(path)


def write_label_text(labels: DataFrame, path: str) -> None:
    """One row per image: split, name and label text, blank for empty images (K4)."""
    labels.select("split", "name", "label_text").write.mode("overwrite").partitionBy("split").json(path)


def write_label_files(labels: DataFrame, path: str) -> None:
    """``<split>/<name>.txt`` per image, an empty file for an image without annotations (K4)."""
    text = F.when(F.coalesce("label_text", F.lit("")) == "", F.lit("")).otherwise(F.concat("label_text", F.lit("\n")))
    write_named_files(labels, path, F.concat_ws("/", "split", F.concat("name", F.lit(".txt"))), text, whole=True)


def write_coco_documents(images: DataFrame, annotations: DataFrame, path: str) -> None:
    """One JSON document ``instances_<split>.json`` per split (K3). Many tasks make its lines; one puts their bytes together. ``write_coco`` and
    ``write_coco_tables`` are the forms without that."""
    lines = coco_document_lines(images, annotations)
    write_large_files(lines, path, F.concat(F.lit("instances_"), "split", F.lit(".json")), F.col("line"), ["part", "id"])


def write_report(df: DataFrame, path: str) -> None:
    """Report rows as nested JSON lines (K5)."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def append_metrics_log(df: DataFrame, path: str) -> None:
    """Add records to a JSON-lines history (K6)."""
    df.write.mode("append").json(path)


def write_registry(df: DataFrame, path: str) -> None:
    """The registry as JSON lines and as CSV, its split map as sorted JSON text (K7)."""
    ordered = df.orderBy("dataset_id")
    ordered.write.mode("overwrite").json(f"{path}/json")
    _write_csv(fixed_columns(ordered, INDEX_COLUMNS["registry"]), f"{path}/csv")


def fixed_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns in order, blank where the table lacks one (K8)."""
    return df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def write_index(df: DataFrame, path: str, kind: str) -> None:
    """Ring, crop, hash or candidate index with its fixed columns (K8)."""
    _write_csv(fixed_columns(df, INDEX_COLUMNS[kind]), path)


def mask_contract(df: DataFrame, dataset_id: str) -> DataFrame:
    """Samples with ready masks and how to read them (K9)."""
    listed = ";".join(["0=background", *[f"{number}={name}" for name, number in CATEGORY_IDS.items()]])
    return df.where(F.col("dataset_id") == dataset_id).select(
        "sample_id", "split", F.col("defect_mask_path").alias("source_semantic_mask"),
        F.lit("prebuilt_two_class_id_mask").alias("decoder"), F.lit(listed).alias("unified_category_ids"),
    )


def write_mask_contract(df: DataFrame, path: str, dataset_id: str) -> None:
    _write_csv(mask_contract(df, dataset_id), path)


def report_table(profile: DataFrame, splits: DataFrame) -> DataFrame:
    """Markdown row of each dataset of a quality profile."""
    numbers = ["ring_labels", "pith_labels", "defect_box_labels", "defect_mask_labels", "defect_class_labels",
               "ignored_defect_instances"]
    cells = [F.col("dataset_id"), F.col("images").cast("string"), F.col("groups").cast("string"), map_text("counts"),
             *[F.col(n).cast("string") for n in numbers]]
    return profile.join(splits, "dataset_id").select(
        "dataset_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")
    )
