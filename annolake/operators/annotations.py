"""Building and exporting annotation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.functions.geometry import (
    box_area, box_array, flat_polygon, polygon_area, polygon_bbox, round_half_even, shape_type_geometry, yolo_box_line, yolo_polygon_line,
)
from annolake.operators.order import ranked
from annolake.operators.shapes import parsed_shapes
from annolake.operators.taxonomy import category_id, map_taxonomy, partition_targets
from annolake.presets import CATEGORY_IDS, IGNORE_REASON, NORMAL_SOURCES

BOX_DIGITS = 4


def _annotation_columns(keys: Sequence[str], area: Column, polygons: Column, geometry: Column) -> list[Column]:
    return [
        *[F.col(k) for k in keys], category_id(F.col("category")).alias("category_id"), "category", "subtype", "attributes",
        "source_class", "instance_id", box_array(F.col("box")).alias("bbox"), area.alias("area"), F.lit(0).alias("iscrowd"),
        polygons.alias("polygons"), geometry.alias("geometry_type"),
    ]


def annotations_from_boxes(
    boxes: DataFrame, taxonomy: DataFrame, keys: Sequence[str] = ("image_id",), fallback: str = "unknown", accept_missing_action: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Annotation rows of labelled pixel boxes, and the ignore regions of the others.

    ``boxes``: keys, dataset_id, raw_label, box (xywh) and, where the source knows it, truncated.
    """
    mapped = map_taxonomy(boxes, taxonomy, fallback=fallback)
    if "truncated" in boxes.columns:
        mapped = mapped.withColumn("attributes", F.when(
            F.col("truncated"), F.array_union("attributes", F.array(F.lit("truncated")))).otherwise(F.col("attributes")))
    mapped = mapped.withColumn("source_class", F.col("raw_label")).withColumn("instance_id", F.lit(None).cast("string"))
    targets, rest = partition_targets(mapped, accept_missing_action)
    area = round_half_even(box_area(F.col("box")), BOX_DIGITS)
    none = F.lit(None).cast("array<array<double>>")
    return (
        targets.select(*_annotation_columns(keys, area, none, F.lit("bbox"))),
        rest.select(*keys, box_array(F.col("box")).alias("bbox"), "source_class", F.lit(IGNORE_REASON).alias("reason")),
    )


def annotations_from_shapes(shapes: DataFrame, keys: Sequence[str] = ("file",)) -> tuple[DataFrame, DataFrame]:
    """Annotation rows of polygon label files, and the ignore regions of their other classes.

    ``shapes``: keys, label, shape_type, points. Shapes without a readable label or outline give neither.
    """
    rows = parsed_shapes(shapes).where(F.col("parsed").isNotNull() & (F.size("polygon") >= 3))
    label = F.col("parsed")
    attributes = F.array_compact(F.array(
        F.when(label["truncated"], "truncated"),
        F.when(label["visibility"] != "clear", F.concat(F.lit("visibility_"), label["visibility"])),
        F.when(label["affects_rings"], "affects_rings"),
    ))
    rows = rows.select(
        *keys, "polygon", "shape_type", F.col("label").alias("source_class"), label["category"].alias("category"), label["subtype"].alias("subtype"),
        attributes.alias("attributes"), label["instance_id"].alias("instance_id"), polygon_bbox(F.col("polygon")).alias("box"))
    primary = F.col("category").isin(list(CATEGORY_IDS))
    outline = F.array(flat_polygon(F.col("polygon")))
    return (
        rows.where(primary).select(*_annotation_columns(keys, polygon_area(F.col("polygon")), outline, shape_type_geometry(F.col("shape_type")))),
        rows.where(~primary).select(*keys, box_array(F.col("box")).alias("bbox"), "source_class", F.lit(IGNORE_REASON).alias("reason")),
    )


def with_ignore_regions(images: DataFrame, ignored: DataFrame, key: str = "image_id", image_key: str = "id") -> DataFrame:
    """Images with their ignore regions in box order and their number."""
    regions = ignored.groupBy(F.col(key).alias("_image")).agg(
        F.sort_array(F.collect_list(F.struct("bbox", "source_class", "reason"))).alias("_regions"))
    kept = [c for c in images.columns if c not in ("ignore_bboxes", "ignored_instance_count")]
    empty = F.array().cast("array<struct<bbox:array<double>,source_class:string,reason:string>>")
    return images.join(regions, F.col(image_key) == F.col("_image"), "left").select(
        *kept, F.coalesce("_regions", empty).alias("ignore_bboxes"), F.coalesce(F.size("_regions"), F.lit(0)).alias("ignored_instance_count"))


def assign_dense_ids(df: DataFrame, order: Sequence[str], by: Sequence[str] = ("split",), name: str = "new_id") -> DataFrame:
    """Consecutive ids from 1 per split over merged sources, in source and old id order."""
    return ranked(df, [F.col(c) for c in order], list(by), name)


def renumber(images: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense image and annotation ids per split, annotations following their image.

    Both carry ``source`` and the old ids, which are unique per (source, split).
    """
    # Only keys are ranked; the other columns join back on them.
    numbered = images.join(assign_dense_ids(images.select("source", "split", "id"), ["source", "id"]), ["source", "split", "id"])
    remap = numbered.select("source", "split", F.col("id").alias("image_id"), F.col("new_id").alias("new_image_id"))
    own = ["source", "split", "image_id", "id"]
    placed = annotations.select(*own).join(remap, ["source", "split", "image_id"])
    moved = annotations.join(assign_dense_ids(placed, ["source", "image_id", "id"]), own)
    return (
        numbered.withColumn("old_id", F.col("id")).withColumn("id", F.col("new_id")).drop("new_id"),
        moved.withColumn("old_id", F.col("id")).withColumn("id", F.col("new_id"))
        .withColumn("image_id", F.col("new_image_id")).drop("new_id", "new_image_id"),
    )


def crop_index(
    images: DataFrame, annotations: DataFrame, root: str = "crops",
    normal_sources: Sequence[str] = tuple(NORMAL_SOURCES), exclude: Sequence[str] = (),
) -> DataFrame:
    """One crop per annotation, and one normal crop per verified-negative image without any.

    ``images``: id, file_name, source_dataset, group_id, split, defect_label_state;
    ``annotations``: id, image_id, category, subtype, attributes, source_class,
    geometry_type, bbox (array). Ignore-only images give no crop at all.
    """
    kept = images.where(~F.col("source_dataset").isin(list(exclude))) if exclude else images
    own = kept.select(
        F.col("id").alias("image_id"), F.col("file_name").alias("source_image"), "source_dataset",
        F.col("group_id").alias("_group"), "split", "defect_label_state",
    )
    child = annotations.select("image_id", F.struct(
        F.col("id").cast("long").alias("id"), "category", "subtype", "attributes", "source_class", "geometry_type", "bbox"
    ).alias("a"))
    joined = own.join(child, "image_id", "left")
    normal = F.col("a").isNull()
    allowed = (F.col("defect_label_state") == "verified_negative") & F.col("source_dataset").isin(list(normal_sources))
    joined = joined.where(~normal | F.coalesce(allowed, F.lit(False)))
    a = F.col("a")
    category = F.when(normal, "normal").otherwise(a["category"])
    name = F.when(
        normal, F.format_string("%s_%06d_normal.jpg", "source_dataset", "image_id")
    ).otherwise(F.format_string("%s_%06d_%07d.jpg", F.col("source_dataset"), F.col("image_id"), a["id"]))
    either = lambda fixed, value: F.when(normal, fixed).otherwise(value)
    return joined.select(
        F.concat_ws("/", F.lit(root), "split", category, name).alias("crop_path"),
        "source_image", "source_dataset", F.col("_group").alias("group_id"), "split", category.alias("category"),
        either("", F.coalesce(a["subtype"], F.lit(""))).alias("subtype"),
        either("verified_negative", F.array_join(F.coalesce(a["attributes"], F.array().cast("array<string>")), ";")).alias("attributes"),
        either("verified_negative", F.coalesce(a["source_class"], F.lit(""))).alias("source_class"),
        either("image_level", F.coalesce(a["geometry_type"], F.lit("bbox"))).alias("annotation_geometry"),
        either("", F.array_join(a["bbox"].cast("array<string>"), ",")).alias("bbox"),
    )


def _export_flags(images: DataFrame, annotations: DataFrame, sources: Sequence[str] | None, segment: bool) -> DataFrame:
    """Images with the reason they are left out of an export, null where they stay."""
    lacking = F.coalesce(F.size(F.filter("polygons", lambda p: F.size(p) >= 6)), F.lit(0)) <= 0
    lines = F.when(lacking, 0).otherwise(F.size(F.filter("polygons", lambda p: F.size(p) >= 6))) if segment else F.lit(1)
    per_image = annotations.groupBy("image_id").agg(
        F.sum(lines).alias("_lines"), (F.count_if(lacking) if segment else F.lit(0)).alias("_lacking")
    )
    foreign = F.lit(False) if sources is None else ~F.col("source_dataset").isin(list(sources))
    return (
        images.withColumn("image_id", F.col("id")).join(per_image, "image_id", "left")
        .withColumn("_lines", F.coalesce("_lines", F.lit(0)).cast("long"))
        .withColumn(
            "skipped",
            F.when(foreign, "source").when(F.col("ignored_instance_count") > 0, "ignore")
            .when(F.coalesce("_lacking", F.lit(0)) > 0, "segmentation"),
        )
    )


def export_counts(images: DataFrame, annotations: DataFrame, sources: Sequence[str] | None = None, segment: bool = False) -> DataFrame:
    """Per split: images, annotations and empty images written, and images skipped by reason."""
    rows = _export_flags(images, annotations, sources, segment)
    stay = F.col("skipped").isNull()
    why = lambda reason: F.count_if(F.col("skipped") == reason)
    return rows.groupBy("split").agg(
        F.count_if(stay).alias("images"),
        F.coalesce(F.sum(F.when(stay, F.col("_lines"))), F.lit(0)).alias("annotations"),
        F.count_if(stay & (F.col("_lines") == 0)).alias("empty_images"),
        why("source").alias("skipped_images"), why("ignore").alias("skipped_ignore_images"),
        why("segmentation").alias("skipped_missing_segmentation"),
    )


def label_lines(images: DataFrame, annotations: DataFrame, sources: Sequence[str] | None = None, segment: bool = False) -> DataFrame:
    """Label text of every exported image, blank when it has no annotation.

    ``annotations``: id, image_id, category_id (1-based), bbox (xywh struct), polygons (flat).
    Lines of one image are put together in order of annotation id, those of one id in text order.
    """
    stay = _export_flags(images, annotations, sources, segment).where(F.col("skipped").isNull())
    size = stay.select("image_id", F.col("width").cast("double").alias("_w"), F.col("height").cast("double").alias("_h"))
    joined = annotations.join(size, "image_id")
    index = F.col("category_id") - 1
    if segment:
        lines = F.transform(
            F.filter("polygons", lambda p: F.size(p) >= 6),
            lambda p: yolo_polygon_line(index, p, F.col("_w"), F.col("_h")),
        )
    else:
        lines = F.array(yolo_box_line(index, F.col("bbox"), F.col("_w"), F.col("_h")))
    text = joined.select("image_id", F.struct("id", lines.alias("lines")).alias("_l")).groupBy("image_id").agg(
        F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list("_l")), lambda e: e["lines"])), "\n").alias("_text")
    )
    return stay.join(text, "image_id", "left").select(
        "split", "image_id", F.lpad(F.col("image_id").cast("string"), 8, "0").alias("name"),
        F.coalesce("_text", F.lit("")).alias("label_text"),
    )


def mask_source_counts(annotations: DataFrame, source: Column) -> DataFrame:
    """How many masks come from polygons, RLE or boxes."""
    return annotations.groupBy(source.alias("mask_source")).agg(F.count(F.lit(1)).alias("masks"))
