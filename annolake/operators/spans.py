"""Masks as runs: interval algebra by sweeps over one image row at a time, never opened into pixels.

A run is a row (keys, y, x1, x2) and stands for the pixels x1 to x2 - 1 of image row y. Runs of one mask may overlap or touch; ``merged``
makes them disjoint. Everything shuffles runs, not pixels: a filled mask of w x h pixels is h rows here. Windows and lists hold one
image row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolake.operators.metrics import pair_scores
from annolake.operators.raster import box_rows, polygon_spans, rounded_points, trace_lines


def merged(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The union of the runs of each key as disjoint runs with a gap between any two: a sweep by start, with the furthest end so far."""
    row = [*keys, "y"]
    order = Window.partitionBy(*row).orderBy("x1", "x2")
    reach = F.max("x2").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("x1") > reach).cast("int"), F.lit(1))
    swept = runs.where("x1 < x2").select(*row, "x1", "x2", opens.alias("_opens"))
    return swept.withColumn("_n", F.sum("_opens").over(order)).groupBy(*row, "_n").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2")).drop("_n")


def pixel_runs(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Disjoint runs of masks given as pixels."""
    return merged(pixels.select(*keys, "y", F.col("x").alias("x1"), (F.col("x") + 1).alias("x2")), keys)


def fill_runs(df: DataFrame, keys: Sequence[str], border: bool = False, points: str = "points") -> DataFrame:
    """Disjoint runs of polygon fills, with the outline of the rounded vertices if ``border``."""
    if not border:
        return merged(polygon_spans(df, keys, points=points), keys)
    whole = df.withColumn(points, rounded_points(F.col(points)))
    edge = trace_lines(whole, keys, closed=True, points=points)
    return merged(polygon_spans(whole, keys, points=points).unionByName(
        edge.select(*keys, "y", F.col("x").alias("x1"), (F.col("x") + 1).alias("x2"))), keys)


def areas(runs: DataFrame, keys: Sequence[str], name: str = "area") -> DataFrame:
    """Pixels of each mask, from disjoint runs."""
    return runs.groupBy(*keys).agg(F.sum((F.col("x2") - F.col("x1")).cast("long")).alias(name))


def overlaps(left: DataFrame, right: DataFrame, row: Sequence[str], keys: Sequence[str], name: str = "inter") -> DataFrame:
    """Shared pixels of masks that meet in a ``row``, summed by ``keys`` (of either side), from disjoint runs."""
    a, b = left.withColumnsRenamed({"x1": "_a1", "x2": "_a2"}), right.withColumnsRenamed({"x1": "_b1", "x2": "_b2"})
    # Runs are many more than the outlines Spark knows the size of: never sent whole to every task.
    both = a.join(b.hint("merge"), list(row)).where("_a1 < _b2 and _b1 < _a2")
    return both.groupBy(*keys).agg(F.sum((F.least("_a2", "_b2") - F.greatest("_a1", "_b1")).cast("long")).alias(name))


def segments(runs: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Every row cut at all ends of its runs: keys, y, x1, x2 and ``cover``, the sorted distinct values of the runs over the piece.

    Pieces under no run are left out.
    """
    listed = runs.where("x1 < x2").groupBy(*keys, "y").agg(F.collect_set(F.struct("x1", "x2", value.alias("v"))).alias("_runs"))
    ends = F.array_sort(F.array_distinct(F.concat(F.transform("_runs", lambda r: r["x1"]), F.transform("_runs", lambda r: r["x2"]))))
    pieces = listed.withColumn("_ends", ends).withColumn("_piece", F.explode(F.zip_with(
        F.slice("_ends", F.lit(1), F.size("_ends") - 1), F.slice("_ends", F.lit(2), F.size("_ends") - 1), lambda a, b: F.struct(a.alias("x1"), b.alias("x2")))))
    over = F.filter("_runs", lambda r: (r["x1"] <= F.col("_piece.x1")) & (r["x2"] >= F.col("_piece.x2")))
    return pieces.select(
        *keys, "y", F.col("_piece.x1").alias("x1"), F.col("_piece.x2").alias("x2"),
        F.array_sort(F.array_distinct(F.transform(over, lambda r: r["v"]))).alias("cover")).where(F.size("cover") > 0)


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Disjoint runs of what is in ``left`` and not in ``right``, key by key."""
    names = [*keys, "y", "x1", "x2"]
    both = left.select(*names, F.lit(0).alias("_side")).unionByName(right.select(*names, F.lit(1).alias("_side")))
    return merged(segments(both, keys, F.col("_side")).where(F.col("cover") == F.array(F.lit(0))), keys)


def painted(runs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Disjoint runs of the largest value over each pixel; runs of one value that touch are one."""
    top = segments(runs, keys, F.col(value)).select(*keys, "y", "x1", "x2", F.array_max("cover").alias(value))
    return merged(top, [*keys, value])


def mask_pairs_runs(preds: DataFrame, gts: DataFrame, keys: Sequence[str] = ("image_id", "class")) -> DataFrame:
    """IoU and Dice of every overlapping mask pair, from the disjoint runs of predictions (pred_id) and truths (gt_id)."""
    keys = list(keys)
    inter = overlaps(preds, gts, [*keys, "y"], [*keys, "pred_id", "gt_id"])
    joined = inter.join(areas(preds, [*keys, "pred_id"], "pred_area"), [*keys, "pred_id"]).join(
        areas(gts, [*keys, "gt_id"], "gt_area"), [*keys, "gt_id"])
    return pair_scores(joined, keys)


def non_nested_runs(rings: DataFrame) -> DataFrame:
    """Adjacent ring pairs whose inner fill leaves the outer one, per image (W7): the shared length falls short of the inner area."""
    fills = fill_runs(rings, ["image_id", "ring"], border=True)
    inner = fills.withColumn("outer", F.col("ring") + 1)
    shared = overlaps(inner, fills.withColumnRenamed("ring", "outer"), ["image_id", "outer", "y"], ["image_id", "ring"])
    last = rings.groupBy("image_id").agg(F.max("ring").alias("_last"))
    loose = areas(fills, ["image_id", "ring"]).join(last, "image_id").where("ring < _last").join(
        shared, ["image_id", "ring"], "left").where(F.coalesce("inter", F.lit(0)) < F.col("area"))
    bad = loose.groupBy("image_id").agg(F.count(F.lit(1)).alias("_bad"))
    return last.join(bad, "image_id", "left").select(
        "image_id", (F.col("_last") + 1).alias("closed_rings"), F.coalesce("_bad", F.lit(0)).alias("non_nested_pairs"))


def paint_annotation_runs(annotations: DataFrame) -> DataFrame:
    """The semantic mask as runs: largest category over each pixel, from polygons, else boxes.

    ``annotations``: image_id, category_id, polygons (array of point arrays), box, width, height.
    """
    known = annotations.where(F.col("category_id") > 0)
    listed = known.withColumn("_usable", F.filter(F.coalesce("polygons", F.array().cast("array<array<array<double>>>")), lambda p: F.size(p) >= 3))
    keys = ["image_id", "category_id"]
    filled = polygon_spans(listed.select(*keys, "width", "height", F.explode("_usable").alias("points")), keys)
    boxed = box_rows(listed.where(F.size("_usable") == 0), keys)
    names = [*keys, "y", "x1", "x2"]
    return painted(filled.select(*names).unionByName(boxed.select(*names)), ["image_id"], "category_id")
