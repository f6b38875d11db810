"""One-row reports: catalog quality and artifact integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.functions.geometry import box_in_bounds, box_struct, polygons_wellformed, rle_wellformed
from annolake.operators.catalog import missing_references, references
from annolake.operators.profile import duplicate_keys, invalid_images
from annolake.operators.provenance import inventory_fingerprint
from annolake.operators.splits import split_leaks
from annolake.presets import CATEGORY_IDS, CLASSES, NORMAL_SOURCES
from annolake.schema import PATH_COLUMNS


def _rows(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def quality_report(catalog: DataFrame, assets: DataFrame, fields: list[str] = PATH_COLUMNS) -> DataFrame:
    """Duplicates, missing files, unreadable images and leaks with the overall status."""
    report = catalog.agg(F.count(F.lit(1)).alias("total_images")).select(
        "total_images",
        _rows(duplicate_keys(catalog, "image_path")).alias("duplicate_image_paths"),
        _rows(missing_references(catalog, fields, assets)).alias("missing_files"),
        _rows(invalid_images(catalog)).alias("invalid_images"),
        _rows(split_leaks(catalog)).alias("split_leaks"),
        inventory_fingerprint(catalog).select("inventory_sha256").scalar().alias("inventory_sha256"),
    )
    bad = F.col("duplicate_image_paths") + F.col("missing_files") + F.col("invalid_images") + F.col("split_leaks")
    return report.withColumn("status", F.when(bad == 0, "ok").otherwise("error"))


def box_errors(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations whose image is absent, category unknown, box or segmentation malformed.

    ``annotations``: id, image_id, category_id, bbox (array), polygons, rle.
    """
    size = images.select(F.col("id").alias("image_id"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    joined = annotations.join(size, "image_id", "left")
    known = F.col("_w").isNotNull() & F.col("category_id").isin(list(CATEGORY_IDS.values()))
    box = box_struct(F.col("bbox"))
    segmented = (F.coalesce(F.size("polygons"), F.lit(0)) > 0) | F.col("rle").isNotNull()
    wellformed = F.when(F.col("rle").isNotNull(), rle_wellformed(F.col("rle"), F.col("_w"), F.col("_h"))).otherwise(
        polygons_wellformed(F.col("polygons"))
    )
    no = lambda flag: ~F.coalesce(flag, F.lit(False))
    return joined.select(
        "id", "image_id", "category_id", segmented.alias("segmented"),
        (no(known) | (segmented & no(wellformed))).alias("reference_error"),
        (known & no(box_in_bounds(box, F.col("_w"), F.col("_h")))).alias("bbox_error"),
    )


def ignore_errors(images: DataFrame) -> DataFrame:
    """Ignore regions with a flag for boxes without size or outside their image."""
    regions = images.select("id", "width", "height", F.explode("ignore_bboxes").alias("r"))
    return regions.select(
        "id", (~F.coalesce(box_in_bounds(box_struct(F.col("r.bbox")), F.col("width"), F.col("height"), low=0.0), F.lit(False))).alias("ignore_error")
    )


def _named(df: DataFrame, **values: Column) -> DataFrame:
    """One row per value: name and value, from one aggregate over ``df``."""
    one = df.agg(*[F.coalesce(value.cast("long"), F.lit(0).cast("long")).alias(name) for name, value in values.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("value")) for name in values])))


#: What a row of the tagged union stands for; each is counted by key.
ROLES = ("expected_ring", "done_ring", "parent", "image", "crop_parent", "crop", "asset", "ring_file", "image_file", "crop_file", "image_id")


def _tagged(df: DataFrame, role: str, key: Column, split: Column | None = None, group: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        key.alias("key"), F.lit(role).alias("role"), F.struct(
            (none if split is None else split.cast("string")).alias("split"), (none if group is None else group.cast("string")).alias("group_id")).alias("owner"))


def keyed_checks(catalog: DataFrame, ring_index: DataFrame, images: DataFrame, crops: DataFrame, assets: DataFrame) -> DataFrame:
    """name and value of every check that compares keys of two tables, from one tagged union in one exchange.

    Rows meet by a key with its kind in front: sample, source image, path or image id. By key and owner (split and group) they are counted per
    role, then by key, where the least owner of the parents is the one that children have to carry.
    """
    c = F.col
    kind = lambda name, *columns: F.concat(F.lit(name), *[F.concat(F.lit("|"), c(x).cast("string")) for x in columns])
    outputs = ["model_image_path", "skeleton_path", "boundary_path", "distance_path", "instance_path", "valid_path"]
    rows = [
        _tagged(catalog.where("has_ring"), "expected_ring", kind("sample", "sample_id")),
        _tagged(ring_index.where(c("status") == "ok"), "done_ring", kind("sample", "sample_id")),
        _tagged(catalog.where("sample_id is not null"), "parent", kind("sample", "sample_id"), c("split"), c("group_id")),
        _tagged(images, "image", kind("sample", "sample_id"), c("split"), c("group_id")),
        _tagged(catalog.where("image_path is not null"), "crop_parent", kind("source", "image_path"), c("split"), c("group_id")),
        _tagged(crops, "crop", kind("source", "source_image"), c("split"), c("group_id")),
        _tagged(assets.where("path is not null"), "asset", kind("path", "path")),
        _tagged(references(ring_index, outputs, ["sample_id"]), "ring_file", kind("path", "path")),
        _tagged(images, "image_file", kind("path", "file_name")), _tagged(crops, "crop_file", kind("path", "crop_path")),
        _tagged(images, "image_id", F.concat(F.lit("id"), *[F.coalesce(F.concat(F.lit("|"), c(x).cast("string")), F.lit("~")) for x in ("split", "id")])),
    ]
    union = rows[0]
    for one in rows[1:]:
        union = union.unionByName(one)
    owned = union.repartition("key").groupBy("key", "owner").agg(*[F.count_if(c("role") == role).alias(role) for role in ROLES])
    of_parent = lambda child, parent: F.coalesce(F.min_by(child, F.when(c(parent) > 0, c("owner"))), F.lit(0))
    keys = owned.groupBy("key").agg(
        *[F.sum(role).alias(role) for role in ROLES], of_parent("image", "parent").alias("true_images"), of_parent("crop", "crop_parent").alias("true_crops"))
    lost = lambda role: F.sum(F.when(c("asset") == 0, c(role)))
    return _named(
        keys, ring_missing=F.count_if((c("expected_ring") > 0) & (c("done_ring") == 0)), ring_extra=F.count_if((c("done_ring") > 0) & (c("expected_ring") == 0)),
        ring_missing_paths=lost("ring_file"), lost_images=lost("image_file"), crop_missing=lost("crop_file"),
        duplicate_image_ids=F.count_if(c("image_id") > 1), group_split_errors=F.sum(c("image") - c("true_images")),
        crop_inheritance_errors=F.sum(c("crop") - c("true_crops")))


def integrity_report(
    catalog: DataFrame, ring_index: DataFrame, images: DataFrame, annotations: DataFrame,
    crops: DataFrame, assets: DataFrame, prebuilt: list[str] = ["vsb"],
) -> DataFrame:
    """Coverage, bounds, references, inheritance and expected totals with errors and status.

    One aggregate per table and one for all checks by key; their values are rows of name and value, put side by side last.
    """
    primary = F.col("supervision_scope") == "primary"
    labelled = primary & (F.col("defect_label_state") != "missing")
    negatives = (F.col("defect_label_state") == "verified_negative") & F.col("dataset_id").isin(NORMAL_SOURCES)
    every = F.count(F.lit(1))
    values = [
        _named(catalog, manifest_images=every, expected_images=F.count_if(labelled), expected_annotations=F.sum(F.when(labelled, F.col("defect_instance_count"))),
               expected_ignore_regions=F.sum(F.when(primary & ~F.col("dataset_id").isin(prebuilt), F.col("ignored_defect_instance_count"))),
               expected_normal_crops=F.count_if(negatives)),
        _named(ring_index, non_nested_pairs=F.sum("non_nested_pairs")),
        _named(images, images=every),
        _named(box_errors(images, annotations), annotations=every, segmented_annotations=F.count_if("segmented"), bbox_errors=F.count_if("bbox_error"),
               wrong_references=F.count_if("reference_error")),
        _named(ignore_errors(images), ignore_regions=every, ignore_bbox_errors=F.count_if("ignore_error")),
        _named(crops, crop_rows=every, unexpected_crop_categories=F.count_if(~F.col("category").isin(CLASSES))),
        keyed_checks(catalog, ring_index, images, crops, assets),
    ]
    told = values[0]
    for one in values[1:]:
        told = told.unionByName(one)
    at = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    names = [
        "manifest_images", "expected_images", "expected_annotations", "expected_ignore_regions", "expected_normal_crops", "ring_missing", "ring_extra",
        "ring_missing_paths", "non_nested_pairs", "images", "duplicate_image_ids", "annotations", "segmented_annotations", "bbox_errors"]
    more = ["group_split_errors", "ignore_regions", "ignore_bbox_errors", "crop_rows", "crop_missing", "crop_inheritance_errors", "unexpected_crop_categories"]
    report = told.agg(
        *[at(name).alias(name) for name in names], (at("wrong_references") + at("lost_images")).alias("reference_errors"), *[at(name).alias(name) for name in more])
    c = F.col
    problem = lambda test, text, *parts: F.when(test, F.concat(F.lit(text), *[p.cast("string") for p in parts]))
    gap = lambda want, have: (F.lit("expected="), c(want), F.lit(", actual="), c(have))
    # The texts of the report's errors and warnings, as written output.
    errors = F.array_compact(F.array(
        problem((c("ring_missing") > 0) | (c("ring_extra") > 0), "ring target sample mismatch: missing=", c("ring_missing"), F.lit(", extra="), c("ring_extra")),
        problem(c("ring_missing_paths") > 0, "missing ring target files: ", c("ring_missing_paths")),
        problem(c("duplicate_image_ids") > 0, "duplicate image ids: ", c("duplicate_image_ids")),
        problem(c("bbox_errors") > 0, "invalid or out-of-bounds boxes: ", c("bbox_errors")),
        problem(c("reference_errors") > 0, "invalid references or segmentations: ", c("reference_errors")),
        problem(c("group_split_errors") > 0, "group or split inheritance errors: ", c("group_split_errors")),
        problem(c("ignore_bbox_errors") > 0, "invalid ignore boxes: ", c("ignore_bbox_errors")),
        problem(c("images") != c("expected_images"), "image coverage mismatch: ", *gap("expected_images", "images")),
        problem(c("annotations") != c("expected_annotations"), "instance mismatch: ", *gap("expected_annotations", "annotations")),
        problem(c("ignore_regions") != c("expected_ignore_regions"), "ignore-region mismatch: ", *gap("expected_ignore_regions", "ignore_regions")),
        problem(c("crop_missing") > 0, "missing indexed crops: ", c("crop_missing")),
        problem(c("crop_inheritance_errors") > 0, "crop group or split inheritance errors: ", c("crop_inheritance_errors")),
        problem(c("unexpected_crop_categories") > 0, "unexpected crop categories: ", c("unexpected_crop_categories")),
        problem(
            c("crop_rows") != c("expected_annotations") + c("expected_normal_crops"), "crop coverage mismatch: expected=",
            c("expected_annotations") + c("expected_normal_crops"), F.lit(", actual="), c("crop_rows"),
        ),
    ))
    warnings = F.array_compact(F.array(
        problem(c("non_nested_pairs") > 0, "adjacent ring pairs leaving the next larger ring: ", c("non_nested_pairs"))
    ))
    return report.withColumn("errors", errors).withColumn("warnings", warnings).withColumn(
        "status", F.when(F.size("errors") == 0, "ok").otherwise("error")
    )
