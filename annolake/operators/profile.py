"""Per-dataset counts, duplicates, category totals and storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quality_profile(df: DataFrame) -> DataFrame:
    """Images, groups and label counts per dataset (A1)."""
    state = lambda column, value: F.count_if(F.col(column) == value)
    return df.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("images"),
        F.count_distinct("group_id").alias("groups"),
        F.count_if("has_ring").alias("ring_labels"),
        F.count_if("has_pith").alias("pith_labels"),
        F.count_if("has_defect_box").alias("defect_box_labels"),
        F.count_if("has_defect_mask").alias("defect_mask_labels"),
        F.count_if("has_defect_class").alias("defect_class_labels"),
        state("defect_label_state", "verified_negative").alias("verified_negative"),
        F.sum("ignored_defect_instance_count").alias("ignored_defect_instances"),
        state("ring_label_state", "missing").alias("missing_ring_labels"),
        state("defect_label_state", "missing").alias("missing_defect_labels"),
    )


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys held by more than one row (A3)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def invalid_images(df: DataFrame) -> DataFrame:
    """Rows whose size or bytes are not positive."""
    columns = ["image_width", "image_height", "image_bytes"]
    bad = F.least(*[F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in columns]) <= 0
    return df.where(bad).select("sample_id", "image_path", *columns)


def fold_group_counts(df: DataFrame, fold: str = "ring_r2_fold") -> DataFrame:
    """Distinct groups per fold."""
    return df.groupBy(fold).agg(F.count_distinct("group_id").alias("groups"))


def distinct_join(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """Sorted distinct non-blank values of each key joined by semicolon.

    Values are made distinct by a grouped pass first; only the distinct ones meet.
    """
    values = df.select(*keys, value.alias("_v")).where(F.coalesce(F.col("_v"), F.lit("")) != "").distinct()
    return values.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("_v")), ";").alias(name))


def category_totals(df: DataFrame, group: str = "dataset_id") -> DataFrame:
    """Instances by (group, category) with subtotals and the grand total (A10)."""
    return (
        df.cube(group, "category")
        .agg(F.count(F.lit(1)).alias("instances"), F.grouping_id().alias("level"))
    )


def category_pivot(df: DataFrame, group: str, categories: Sequence[str]) -> DataFrame:
    """One row per group with a column per category and their total (A10)."""
    return df.groupBy(group).agg(
        *[F.count_if(F.col("category") == c).alias(c) for c in categories],
        F.count_if(F.col("category").isin(list(categories))).alias("total"),
    )


def variants_per_group(df: DataFrame, group: str = "group_id") -> DataFrame:
    """How many groups have each number of members."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("variants"))
    return sizes.groupBy("variants").agg(F.count(F.lit(1)).alias("groups"))


def action_counts(audits: DataFrame) -> DataFrame:
    """Occurrences of each change action over all audits."""
    return (
        audits.select(F.explode("changes").alias("change"))
        .groupBy(F.col("change.action").alias("action"))
        .agg(F.count(F.lit(1)).alias("changes"))
    )


def audit_totals(audits: DataFrame) -> DataFrame:
    """Files and shape sums over all audits."""
    total = lambda column: F.coalesce(F.sum(column), F.lit(0)).alias(column)
    return audits.agg(
        F.count(F.lit(1)).alias("files"), total("input_shapes"), total("output_shapes"),
        total("primary_instances"), total("ignored_instances"),
    )


def storage_profile(assets: DataFrame) -> DataFrame:
    """Number of files and bytes."""
    return assets.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def target_summary(index: DataFrame) -> DataFrame:
    """Requested, generated and failed targets with ring sums, per dataset and in total."""
    ok = F.col("status") == "ok"
    return index.rollup("dataset_id").agg(
        F.count(F.lit(1)).alias("requested"),
        F.count_if(ok).alias("generated"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("errors"),
        F.coalesce(F.sum("closed_ring_count"), F.lit(0)).alias("closed_rings"),
        F.coalesce(F.sum("non_nested_pairs"), F.lit(0)).alias("non_nested_pairs"),
    )


def nonfinite_audit(df: DataFrame, values: str, name: str) -> DataFrame:
    """Vectors and values in total, NaN or infinite values, and the vectors holding them."""
    bad = F.size(F.filter(values, lambda v: F.isnan(v) | (F.abs(v) == float("inf"))))
    counted = df.select(F.col(name), F.size(values).alias("_n"), bad.alias("_bad"))
    return counted.agg(
        F.count(F.lit(1)).alias("vectors"),
        F.sum(F.col("_n").cast("long")).alias("vector_values"),
        F.sum(F.col("_bad").cast("long")).alias("nonfinite_values"),
        F.count_if(F.col("_bad") > 0).alias("nonfinite_vectors"),
    )


def nonfinite_names(df: DataFrame, values: str, name: str) -> DataFrame:
    """Names of vectors holding a NaN or an infinite value."""
    return df.where(F.exists(values, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))).select(name)
