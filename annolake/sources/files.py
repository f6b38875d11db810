"""File sources: catalogs, asset listings, label text, JSON and XML."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolake import schema
from annolake.functions.geometry import center_to_xywh, clip_box, corners_to_xywh
from annolake.functions.labels import none_if_blank
from annolake.operators.order import least_per_key
from annolake.session import stable
from annolake.sources.documents import list_elements
from annolake.sources.listing import list_tree

# Image file extensions.
IMAGE_EXTENSIONS = ("bmp", "jpg", "jpeg", "png")


def _path(column: str = "_metadata.file_path") -> Column:
    return F.url_decode(F.regexp_replace(F.regexp_replace(F.col(column), r"\+", "%2B"), "^file:/*", "/"))


def read_table(spark: SparkSession, path: str, kind: T.StructType) -> DataFrame:
    """Header CSV by column name: text first, then typed; blank numbers become 0.

    Files may hold fewer or more columns than the schema, in any order; absent ones are blank.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=False)
    columns = []
    for field in kind:
        value = F.col(f"`{field.name}`") if field.name in raw.columns else F.lit(None).cast("string")
        if isinstance(field.dataType, T.StringType):
            typed = F.coalesce(value, F.lit(""))
        elif isinstance(field.dataType, T.BooleanType):
            typed = F.coalesce(F.lower(F.trim(value)).isin("1", "true"), F.lit(False))
        else:
            typed = F.coalesce(F.trim(value).try_cast(field.dataType.simpleString()), F.lit(0).cast(field.dataType))
        columns.append(typed.alias(field.name))
    return raw.select(*columns)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A written catalog with its full schema."""
    return read_table(spark, path, schema.CATALOG)


def list_assets(spark: SparkSession, root: str, extensions: Sequence[str] | None = None, glob: str | None = None) -> DataFrame:
    """path, size, mtime (ns) of files under a tree, listed by tasks; file contents are never read.

    ``glob`` matches file names with ``*`` and ``?``.
    """
    files = list_tree(spark, root)
    if glob:
        pattern = "".join({"*": "[^/]*", "?": "[^/]"}.get(sign) or re.escape(sign) for sign in glob)
        files = files.where(F.col("path").rlike(f"/{pattern}$"))
    if extensions is not None:
        ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
        files = files.where(ending.isin([e.lower().lstrip(".") for e in extensions]))
    return files


def read_contents(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path, size, sha256 of whole file contents."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select(
        _path("path").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")
    )


def relative_to(path: Column, root: str) -> Column:
    """Path below a root folder."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), path.substr(F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def read_key_set(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Distinct trimmed non-blank values of one CSV column; empty if the file is absent (S3)."""
    try:
        raw = spark.read.csv(path, header=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{key} string")
    value = F.trim(F.col(f"`{key}`"))
    return raw.select(value.alias(key)).where(F.col(key) != "").distinct()


def read_shape_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per JSON document; the embedded image is left out of the schema."""
    return spark.read.schema(schema.SHAPE_FILE).json(paths, multiLine=True).select(_path().alias("file"), "*")


def read_labelme(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per shape with its position in the file."""
    files = read_shape_files(spark, paths)
    return files.select(
        "file", "imageWidth", "imageHeight", F.posexplode("shapes").alias("shape_index", "_s")
    ).select(
        "file", "shape_index", F.col("_s.label").alias("label"), F.col("_s.shape_type").alias("shape_type"),
        F.col("_s.points").alias("points"), F.col("imageWidth").alias("width"), F.col("imageHeight").alias("height"),
    )


def read_voc_boxes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per object of XML box files, the box clipped to the image."""
    raw = (
        spark.read.format("xml").option("rowTag", "annotation").schema(schema.VOC_ANNOTATION)
        .load(paths).select(_path().alias("file"), "size", F.posexplode("object").alias("object_index", "o"))
    )
    width, height = F.coalesce("size.width", F.lit(0.0)), F.coalesce("size.height", F.lit(0.0))
    edge = lambda name: F.coalesce(F.col(f"o.bndbox.{name}"), F.lit(0.0))
    box = clip_box(edge("xmin"), edge("ymin"), edge("xmax"), edge("ymax"), width, height)
    name = F.trim("o.name")
    return raw.where((name != "") & F.col("o.bndbox").isNotNull()).select(
        "file", "object_index", name.alias("raw_label"),
        (F.coalesce(F.trim("o.truncated"), F.lit("0")) == "1").alias("truncated"),
        box.alias("box"), width.alias("width"), height.alias("height"),
    )


def read_voc_names(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Class names of XML box files, one row per named object."""
    raw = spark.read.format("xml").option("rowTag", "annotation").schema(schema.VOC_ANNOTATION).load(paths)
    return raw.select(_path().alias("file"), F.explode_outer("object.name").alias("_n")).select(
        "file", none_if_blank(F.trim("_n")).alias("raw_label")
    )


def read_cvat_polylines(spark: SparkSession, paths: str | list[str], label: str = "Ring", min_points: int = 2) -> DataFrame:
    """Polylines with the given label and enough points, per image base name."""
    raw = (
        spark.read.format("xml").option("rowTag", "image").schema(schema.CVAT_IMAGE).load(paths)
        .select(_path().alias("file"), F.col("_name").alias("name"), F.col("_width").alias("width"),
                F.col("_height").alias("height"), F.posexplode("polyline").alias("line_index", "p"))
    )
    pairs = F.filter(F.split("p._points", ";"), lambda s: s.contains(","))
    points = F.transform(pairs, lambda s: F.transform(F.slice(F.split(s, ",", 2), 1, 2), lambda v: v.try_cast("double")))
    return raw.where(F.col("p._label") == label).select(
        "file", F.element_at(F.split("name", "/"), -1).alias("image_name"), "width", "height", "line_index",
        points.alias("points"),
    ).where(F.size("points") >= min_points)


def _fields(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    text = spark.read.text(paths).select(
        _path().alias("file"), F.regexp_replace("value", "^﻿", "").alias("line")
    )
    return text.withColumn("_f", F.split(F.trim("line"), r"\s+"))


def read_corner_boxes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``label x1 y1 x2 y2`` lines, decimal commas allowed; other lines are skipped."""
    number = lambda i: F.replace(F.get("_f", F.lit(i)), F.lit(","), F.lit(".")).try_cast("double")
    return _fields(spark, paths).where(F.size("_f") == 5).select(
        "file", F.get("_f", F.lit(0)).alias("raw_label"), number(1).alias("x1"), number(2).alias("y1"),
        number(3).alias("x2"), number(4).alias("y2"),
    )


def read_center_boxes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``class cx cy w h`` lines; others are skipped."""
    number = lambda i: F.get("_f", F.lit(i)).try_cast("double")
    return _fields(spark, paths).where(F.size("_f") == 5).select(
        "file", F.get("_f", F.lit(0)).alias("class_id"), number(1).alias("cx"), number(2).alias("cy"),
        number(3).alias("w"), number(4).alias("h"),
    )


def read_center_polygons(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``class x y x y …`` lines with at least three points."""
    numbers = F.transform(F.slice("_f", 2, F.greatest(F.size("_f") - 1, F.lit(0))), lambda v: v.try_cast("double"))
    return _fields(spark, paths).where(F.size("_f") >= 7).select(
        "file", F.get("_f", F.lit(0)).alias("class_id"), numbers.alias("polygon")
    )


#: Forms of label lines: fields asked for (polygons: at least), how many of them lead the numbers, and whether decimal commas are read.
LINE_FORMS = {"corner_boxes": (5, True), "center_boxes": (5, False), "center_polygons": (7, False)}


def label_line_reasons(spark: SparkSession, paths: str | list[str], form: str) -> DataFrame:
    """Every line of label files with what is wrong with it (S7, S8): file, line, fields and reason.

    reason is null for a good line; ``blank`` (no field), ``fields`` (too few or too many), ``odd`` (a polygon's coordinates do not
    pair), ``number`` (a coordinate is no number) or ``not finite``. The readers skip ``blank`` and ``fields`` lines and give null or
    the value itself in the others, so this is how a user finds what a source has lost.
    """
    wanted, commas = LINE_FORMS[form]
    exact = form != "center_polygons"
    numbers = F.slice("_f", 2, F.greatest(F.size("_f") - 1, F.lit(0)))
    read = F.transform(numbers, lambda v: (F.replace(v, F.lit(","), F.lit(".")) if commas else v).try_cast("double"))
    bad_count = (F.size("_f") != wanted) if exact else (F.size("_f") < wanted)
    reason = (
        F.when(F.trim("line") == "", "blank").when(bad_count, "fields").when(F.lit(not exact) & (F.size("_f") % 2 == 0), "odd")
        .when(F.exists(read, lambda v: v.isNull()), "number").when(F.exists(read, lambda v: F.isnan(v) | (F.abs(v) == float("inf"))), "not finite"))
    return _fields(spark, paths).select("file", "line", F.when(F.trim("line") == "", 0).otherwise(F.size("_f")).alias("fields"), reason.alias("reason"))


def corner_box_pixels(df: DataFrame) -> DataFrame:
    """Pixel boxes of corner lines joined with width and height (G1)."""
    c = F.col
    return df.withColumn("box", corners_to_xywh(c("x1"), c("y1"), c("x2"), c("y2"), c("width"), c("height")))


def center_box_pixels(df: DataFrame) -> DataFrame:
    """Pixel boxes of centre lines joined with width and height."""
    c = F.col
    return df.withColumn("box", center_to_xywh(c("cx"), c("cy"), c("w"), c("h"), c("width"), c("height")))


def read_coco(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of whole documents named ``instances_<split>``.

    A document of any size is read by as many tasks as it has byte ranges. A segmentation is either polygons or run lengths;
    it is read as text and split in two.
    """
    kinds = {"images": schema.COCO_IMAGE, "annotations": schema.COCO_ANNOTATION, "categories": schema.COCO_CATEGORY}
    # Staged: three tables are taken from it.
    elements = stable(list_elements(spark, paths, list(kinds)).select(
        F.regexp_extract("file", r"instances_([^/]+)\.json", 1).alias("_split"), "list", "text"))

    def taken(name: str) -> DataFrame:
        return elements.where(F.col("list") == name).select("_split", F.from_json("text", kinds[name]).alias("e")).select("_split", "e.*")

    images = taken("images").withColumn("split", F.coalesce(none_if_blank(F.col("split")), F.col("_split"))).drop("_split")
    return images, split_segmentation(taken("annotations").withColumnRenamed("_split", "split")), taken("categories").withColumnRenamed("_split", "split")


def read_coco_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same three tables from line-delimited folders partitioned by split."""
    read = lambda name, kind: spark.read.schema(
        T.StructType([*[f for f in kind if f.name != "split"], T.StructField("split", T.StringType())])
    ).json(f"{path}/{name}")
    return (
        read("images", schema.COCO_IMAGE), split_segmentation(read("annotations", schema.COCO_ANNOTATION)),
        read("categories", schema.COCO_CATEGORY),
    )


def split_segmentation(annotations: DataFrame) -> DataFrame:
    """Segmentation text to ``polygons`` (a list) or ``rle`` (an object); null where empty."""
    text = F.trim("segmentation")
    polygons = F.when(text.startswith("["), F.from_json(text, "array<array<double>>"))
    rle = F.when(text.startswith("{"), F.from_json(text, "size array<int>, counts array<int>"))
    return annotations.withColumn("polygons", F.when(F.size(polygons) > 0, polygons)).withColumn("rle", rle).drop("segmentation")


def read_metrics_log(spark: SparkSession, path: str, kind: T.StructType | str) -> DataFrame:
    """JSON-lines history; blank lines give no row."""
    if isinstance(kind, str):
        kind = T.StructType.fromDDL(kind)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", kind).alias("r")).where(F.col("r").isNotNull()).select("r.*")


def read_prebuilt_manifest(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Adopt an outside manifest with its fixed split; inventory counts default to 0."""
    counted = least_per_key(inventory.select(
        "sample_id", F.coalesce(F.col("excluded_instance_count").try_cast("int"), F.lit(0)).alias("_excluded")
    ), "sample_id")
    return manifest.join(counted, "sample_id", "left").withColumn(
        "ignored_defect_instance_count", F.coalesce("_excluded", F.lit(0))
    ).drop("_excluded")


def count_nonblank_lines(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """Non-blank lines per label file (S12). ``glob`` looks through all folders below."""
    reader = spark.read
    if glob:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    lines = reader.text(paths).select(_path().alias("file"), "value")
    return lines.groupBy("file").agg(F.count_if(F.trim("value") != "").alias("lines"))
