"""Catalog joins, set operations and incremental reuse."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.functions.geometry import scale_box, scale_factor, scale_polygons
from annolake.functions.labels import resolve_reference, task_mask
from annolake.operators.order import least_per_key


def union_catalogs(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def attach_children(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations with their image's columns; orphans drop out."""
    parents = images.select(
        F.col("id").alias("image_id"), *[F.col(c).alias(f"image_{c}") for c in images.columns if c != "id"]
    )
    return annotations.join(parents, "image_id")


def reuse_metadata(df: DataFrame, cache: DataFrame) -> DataFrame:
    """Take cached sizes where path and byte size both agree; flag what must be read."""
    cached = least_per_key(cache.select(
        "image_path", "image_bytes", F.col("image_width").alias("_w"), F.col("image_height").alias("_h")
    ), "image_path", "image_bytes")
    known = (F.col("image_width") > 0) & (F.col("image_height") > 0) & (F.col("image_bytes") > 0)
    hit = F.col("_w").isNotNull()
    return (
        df.join(cached, ["image_path", "image_bytes"], "left")
        .withColumn("needs_read", ~F.coalesce(known, F.lit(False)) & ~hit)
        .withColumn("image_width", F.when(known, F.col("image_width")).otherwise(F.coalesce("_w", "image_width", F.lit(0))))
        .withColumn("image_height", F.when(known, F.col("image_height")).otherwise(F.coalesce("_h", "image_height", F.lit(0))))
        .select(*df.columns, "needs_read")
    )


def task_samples(
    catalog: DataFrame, task: str, ring_index: DataFrame | None = None,
    images: DataFrame | None = None, crops: DataFrame | None = None,
) -> DataFrame:
    """Samples a task may use, with its task mask."""
    if task == "classification":
        rows = crops.select(
            F.col("crop_path").alias("sample_id"), "source_image", "split", "group_id", "category"
        )
        return rows.withColumn("mode", F.lit(task)).withColumn("task_mask", task_mask(task))
    rows = catalog
    if task == "bridge":
        rows = rows.where(F.col("dataset_role") == "bridge")
    if task == "ring":
        rows = rows.where("has_ring")
    if task in ("defect", "bridge"):
        rows = rows.where(F.col("defect_label_state") != "missing")
        rows = rows.join(images.select("sample_id"), "sample_id", "left_semi")
    if task in ("ring", "bridge"):
        finished = ring_index.where(F.col("status") == "ok").select("sample_id")
        rows = rows.join(finished, "sample_id", "left_semi")
    return (
        rows.select("sample_id", F.col("image_path").alias("source_image"), "split", "group_id")
        .withColumn("mode", F.lit(task)).withColumn("task_mask", task_mask(task))
    )


def key_set_diff(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, tagged missing or extra (J6), from one grouped pass."""
    tagged = expected.select(key, F.lit(1).alias("_e"), F.lit(0).alias("_a")).unionByName(
        actual.select(key, F.lit(0).alias("_e"), F.lit(1).alias("_a"))
    )
    seen = tagged.groupBy(key).agg(F.max("_e").alias("_e"), F.max("_a").alias("_a"))
    return seen.where(F.col("_e") != F.col("_a")).select(
        key, F.when(F.col("_e") == 1, "missing").otherwise("extra").alias("side")
    )


def references(df: DataFrame, fields: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Path columns unpivoted to (ids, field, path), blanks dropped, archives resolved."""
    return (
        df.select(*ids, *fields)
        .unpivot(list(ids), list(fields), "field", "path")
        .withColumn("path", resolve_reference(F.col("path")))
        .where(F.col("path").isNotNull())
    )


def missing_references(df: DataFrame, fields: Sequence[str], assets: DataFrame) -> DataFrame:
    """References with no asset behind them."""
    return references(df, fields, ["sample_id"]).join(assets.select("path"), "path", "left_anti")


def inheritance_violations(
    child: DataFrame, parent: DataFrame, key: str, columns: Sequence[str] = ("split", "group_id")
) -> DataFrame:
    """Child rows whose parent is absent or carries another split or group."""
    known = parent.select(key, F.lit(True).alias("_found"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in columns])
    joined = child.join(least_per_key(known, key), key, "left")
    return joined.where(F.col("_found").isNull() | ~same).select(*child.columns)


def attach_annotation(assets: DataFrame, annotations: DataFrame, keys: Sequence[str], names: Sequence[Column]) -> DataFrame:
    """First existing candidate name per asset as ``annotation_path``.

    ``annotations`` has the keys, ``name`` and ``path``; candidates are tried in order. Joined by merging: listings grow from
    few rows, and Spark only knows their size before.
    """
    lookup = least_per_key(annotations.select(*keys, "name", "path"), *keys, "name")
    result, found = assets, []
    for position, candidate in enumerate(names):
        column = f"_hit{position}"
        hit = lookup.select(*keys, F.col("name").alias("_name"), F.col("path").alias(column))
        result = result.withColumn("_name", candidate).join(hit.hint("merge"), [*keys, "_name"], "left").drop("_name")
        found.append(F.col(column))
    result = result.withColumn("annotation_path", F.coalesce(*found))
    return result.select(*assets.columns, "annotation_path")


def complete_sets(df: DataFrame, unit: str, member: str, expected: int) -> DataFrame:
    """Units with an annotation for every expected member, e.g. all six faces."""
    annotated = df.where(F.col("annotation_path").isNotNull())
    return annotated.groupBy(unit).agg(F.count_distinct(member).alias("members")).where(F.col("members") == expected)


def apply_override(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """Use the normalised annotation path where there is one."""
    table = least_per_key(overrides.select(
        F.col("source_relative").alias("defect_annotation_path"), F.col("normalized_relative").alias("_normal")
    ), "defect_annotation_path")
    return (
        df.join(table, "defect_annotation_path", "left")
        .withColumn("annotation_source", F.coalesce("_normal", "defect_annotation_path"))
        .select(*df.columns, "annotation_source")
    )


def enrich_registry(registry: DataFrame, catalog: DataFrame) -> DataFrame:
    """Registry rows with catalog counts; rows without images survive with zeros."""
    from annolake.operators.splits import count_map

    counted = catalog.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("manifest_images"),
        F.count_distinct("group_id").alias("physical_groups"),
        F.count_if(F.col("has_ring")).alias("ring_images"),
        F.count_if(F.col("defect_label_state") != "missing").alias("defect_labeled_images"),
        F.sum(F.coalesce("defect_instance_count", F.lit(0))).alias("target_instances_manifest"),
        F.sum(F.coalesce("ignored_defect_instance_count", F.lit(0))).alias("ignored_instances_manifest"),
    )
    numbers = counted.columns[1:]
    splits = count_map(catalog, ["dataset_id"], "split", "splits")
    joined = registry.join(counted, "dataset_id", "left").join(splits, "dataset_id", "left")
    return joined.select(
        *registry.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers],
        F.coalesce("splits", F.create_map().cast("map<string,bigint>")).alias("splits"),
    )


def combine_bridge_sample(ring_index: DataFrame, images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations of samples that also have ring targets, scaled to the target size."""
    targets = ring_index.where(F.col("status") == "ok").select("sample_id", "target_width", "target_height")
    sized = images.select(F.col("id").alias("image_id"), "sample_id", "width", "height").join(targets, "sample_id")
    sx, sy = scale_factor(F.col("target_width"), F.col("width")), scale_factor(F.col("target_height"), F.col("height"))
    joined = annotations.join(sized, "image_id").withColumn("_sx", sx).withColumn("_sy", sy)
    sx, sy = F.col("_sx"), F.col("_sy")
    joined = joined.withColumn("bbox", scale_box(F.col("bbox"), sx, sy)).withColumn("area", F.col("area") * sx * sy)
    if "polygons" in annotations.columns:
        joined = joined.withColumn("polygons", scale_polygons(F.col("polygons"), sx, sy))
    return joined.drop("_sx", "_sy", "width", "height")


def append_precomputed(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Already indexed rows plus those of ``df`` whose key they do not cover."""
    covered = rows.select(key).distinct()
    return rows.unionByName(df.join(covered, key, "left_anti"), allowMissingColumns=True)


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows on one side only; empty means equal sets, no ``unexpected`` a subset."""
    name = left.columns[0]
    return key_set_diff(right, left, name).select(
        name, F.when(F.col("side") == "extra", "unexpected").otherwise("absent").alias("side")
    )


def resume_pending(todo: DataFrame, done: DataFrame, key: str, outputs: Sequence[str], assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split work into (pending, carried): finished rows with every output present carry over."""
    ready = done.where(F.col("status") == "ok")
    for column in outputs:
        ready = ready.where(F.coalesce(F.col(column), F.lit("")) != "")
        ready = ready.join(assets.select(F.col("path").alias(column)), column, "left_semi")
    ready = ready.join(todo.select(key), key, "left_semi")
    return todo.join(ready.select(key), key, "left_anti"), ready.select(*done.columns)
