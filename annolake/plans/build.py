"""The composed jobs: building a catalog, deriving label artifacts, scoring predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.functions.labels import safe_name
from annolake.operators.catalog import append_precomputed, apply_override, reuse_metadata
from annolake.operators.duplicates import duplicate_summary, near_duplicates, resolve_hash
from annolake.operators.order import first_per_key
from annolake.operators.profile import variants_per_group
from annolake.operators.shapes import normalization_actions, normalization_audit, normalize_shapes
from annolake.operators.splits import assign_splits
from annolake.presets import SEED, SPLIT_POLICY


def build_catalog(scanned: DataFrame, cache: DataFrame, policy: dict = SPLIT_POLICY, seed: int = SEED) -> DataFrame:
    """Scanned rows with known sizes and splits; ``needs_read`` marks sizes still unknown.

    Rows whose size stays unknown keep 0 and say so in their notes.
    """
    sized = reuse_metadata(scanned, cache)
    reason = F.lit("image_metadata_error=unread")
    notes = F.when(F.col("needs_read"), F.concat_ws("; ", F.when(F.col("notes") != "", F.col("notes")), reason))
    sized = sized.withColumn("notes", F.coalesce(notes, "notes"))
    return assign_splits(sized, policy, seed)


def normalize_bridge(catalog: DataFrame, shapes: DataFrame, root: str) -> dict[str, DataFrame]:
    """Clean the shape files of bridge samples, each file once, with its audit and new path.

    ``shapes``: file (the annotation path), shape_index, label, shape_type, points.
    """
    bridge = catalog.where((F.col("dataset_role") == "bridge") & (F.col("defect_annotation_path") != ""))
    owners = first_per_key(
        bridge.select("defect_annotation_path", "dataset_id", "sample_id", "image_width", "image_height"),
        ["defect_annotation_path"], ["dataset_id", "sample_id"],
    )
    owned = shapes.join(
        owners.select(F.col("defect_annotation_path").alias("file"), F.col("image_width").alias("width"), F.col("image_height").alias("height")), "file"
    )
    normalized = normalize_shapes(owned)
    target = F.concat_ws("/", F.lit(root), "dataset_id", F.concat(safe_name(F.col("sample_id")), F.lit(".json")))
    paths = owners.select(F.col("defect_annotation_path").alias("source_relative"), target.alias("normalized_relative"))
    return {
        "shapes": normalized, "audit": normalization_audit(normalized), "actions": normalization_actions(normalized),
        "paths": paths, "catalog": apply_override(catalog, paths),
    }


def merge_annotations(sources: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Images and annotations of several sources under one dense numbering per split.

    Each source gives images (id, split, …) and annotations (id, image_id, split, …).
    """
    from annolake.operators.annotations import renumber
    from annolake.operators.catalog import union_catalogs

    tagged = [
        (images.withColumn("source", F.lit(i)), rows.withColumn("source", F.lit(i)))
        for i, (images, rows) in enumerate(sources)
    ]
    return renumber(union_catalogs([a for a, _ in tagged]), union_catalogs([b for _, b in tagged]))


def merge_crops(prebuilt: DataFrame, derived: DataFrame) -> DataFrame:
    """Prebuilt crop rows first; new rows only of datasets they do not cover."""
    return append_precomputed(derived, prebuilt, "source_dataset")


def audit_duplicates(
    catalog: DataFrame, precomputed: DataFrame, cache: DataFrame, computed: DataFrame, threshold: int = 4
) -> dict[str, DataFrame]:
    """Hash index, cross-split candidates and counts of the primary rows.

    ``computed`` (sample_id, phash) fills rows that neither source covers.
    """
    primary = catalog.where(F.col("supervision_scope") == "primary")
    resolved = resolve_hash(primary, precomputed, cache)
    fresh = computed.groupBy("sample_id").agg(F.max("phash").alias("_fresh"))
    index = resolved.join(fresh, "sample_id", "left").withColumn("phash", F.coalesce("phash", "_fresh")).drop("_fresh")
    sources = index.groupBy("hash_source").agg(F.count(F.lit(1)).alias("hashes"))
    return {
        "index": index, "candidates": near_duplicates(index, threshold), "summary": duplicate_summary(index, threshold),
        "sources": sources, "group_sizes": variants_per_group(catalog.where(F.col("supervision_scope") != "primary")),
    }


