"""Overlap joins and greedy one-to-one matching."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolake.functions.geometry import box_iou, xyxy
from annolake.presets import IOU_THRESHOLDS

#: Least ratio of the sides of one size level. Wider levels have fewer rows to shuffle and more boxes in a cell.
WIDE_LEVEL = 64.0
_CELL = ["_lw", "_lh", "_gx", "_gy"]


def iou_pairs(preds: DataFrame, gts: DataFrame, min_iou: float = 0.5, keys: Sequence[str] = ("image_id", "class")) -> DataFrame:
    """Box pairs with IoU of at least ``min_iou`` inside each key.

    ``preds``: keys, pred_id, score, box; ``gts``: keys, gt_id, box (xyxy). An IoU of t needs
    widths and heights within a factor t of each other and centres closer than
    (1-t)/(1+t) of the larger side. Truths get one cell by size level and centre;
    predictions look up the few cells in reach. A pair meets in one cell only. Every cell in
    reach is a row to shuffle, so levels are wide: most predictions have one or two a side.
    """
    if not 0 < min_iou <= 1:
        raise ValueError("min_iou must be in (0, 1]")
    keys = list(keys)
    truth = box_cells(gts, [*keys, "gt_id"], "g", min_iou)
    wide = box_cells(preds, [*keys, "pred_id", "score"], "p", min_iou, around=True)
    # A cheap bound first, so that the ratio is worked out for likely pairs only.
    c = F.col
    across = F.least(c("px2"), c("gx2")) - F.greatest(c("px1"), c("gx1"))
    down = F.least(c("py2"), c("gy2")) - F.greatest(c("py1"), c("gy1"))
    area = lambda tag: (c(f"{tag}x2") - c(f"{tag}x1")) * (c(f"{tag}y2") - c(f"{tag}y1"))
    likely = (across > 0) & (down > 0) & (
        across * down * (1 + min_iou) >= (area("p") + area("g")) * (min_iou * (1 - 1e-9))
    )
    corners = lambda tag: xyxy(*[c(f"{tag}{k}") for k in ("x1", "y1", "x2", "y2")])
    # The work per row is high, so the join is spread over shuffle tasks even if one side is small.
    return (
        wide.hint("merge").join(truth, [*keys, *_CELL]).where(likely)
        .withColumn("iou", box_iou(corners("p"), corners("g")))
        .where(F.col("iou") >= min_iou)
        .select(*keys, "pred_id", "score", "gt_id", "iou")
    )


def box_cells(boxes: DataFrame, columns: Sequence[str], tag: str, min_iou: float, around: bool = False) -> DataFrame:
    """The columns, cell and corners of each box: its own cell, or ``around`` it every cell that a box of this IoU with it can have."""
    base = max(WIDE_LEVEL, 1.0 / max(min_iou, 1e-3) ** 2)
    reach = (1 - min_iou) / (1 + min_iou)
    level = lambda size: F.floor(F.log(size) / math.log(base)).cast("int")
    # Largest partner of a box at this level has side base**(level+1) / t.
    cell = lambda lv: F.greatest(F.lit(1e-9), F.pow(F.lit(base), lv + 1)) * max(2 * reach / min_iou, 1e-3)
    corners = {f"{tag}{k}": F.col(f"box.{k}") for k in ("x1", "y1", "x2", "y2")}
    side = lambda axis: F.col(f"{tag}{axis}2") - F.col(f"{tag}{axis}1")
    middle = lambda axis: (F.col(f"{tag}{axis}1") + F.col(f"{tag}{axis}2")) / 2
    sized = boxes.withColumns(corners).withColumns(
        {"_w": side("x"), "_h": side("y"), "_cx": middle("x"), "_cy": middle("y")}).where((F.col("_w") > 0) & (F.col("_h") > 0))
    if around:
        slack = 1e-9
        levels = lambda size: F.explode(F.sequence(level(size * (min_iou - slack)), level(size / (min_iou - slack))))
        place = lambda centre, size, lv: F.explode(F.sequence(
            F.floor((centre - reach * size / min_iou - slack) / cell(lv)),
            F.floor((centre + reach * size / min_iou + slack) / cell(lv)),
        ))
    else:
        levels = level
        place = lambda centre, size, lv: F.floor(centre / cell(lv))
    return (
        sized.withColumn("_lw", levels(F.col("_w"))).withColumn("_lh", levels(F.col("_h")))
        .withColumn("_gx", place(F.col("_cx"), F.col("_w"), F.col("_lw")))
        .withColumn("_gy", place(F.col("_cy"), F.col("_h"), F.col("_lh")))
        .select(*columns, *_CELL, *corners)
    )


def greedy_assign(
    pairs: DataFrame, keys: Sequence[str], left: str, right: str, order: Sequence[Column],
    weight: str, thresholds: Sequence[float] = (0.0,),
) -> DataFrame:
    """Each left row in ``order`` takes its heaviest free right row of weight >= threshold.

    Pairs are sorted by key and preference and stream through in batches. Within a batch, a pair that comes first among
    the open pairs of both its sides is settled, for all groups and thresholds at once, until none is open. Only the
    pairs settled in the group that a batch ends in are carried to the next one.
    """
    keys = list(keys)
    types = {field.name: field.dataType for field in pairs.schema}
    schema = T.StructType(
        [T.StructField(k, types[k]) for k in keys]
        + [T.StructField("threshold", T.DoubleType()), T.StructField(left, types[left]),
           T.StructField(right, types[right]), T.StructField("weight", T.DoubleType())]
    )
    limits = np.asarray([float(t) for t in thresholds])
    names = [*keys, "threshold", left, right, "weight"]
    ordered = (
        pairs.select(*keys, left, right, F.col(weight).cast("double").alias("weight"), F.struct(*order).alias("_order"))
        .repartition(*keys).sortWithinPartitions(*keys, "_order", left, F.col("weight").desc(), right).drop("_order")
    )

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried = pd.DataFrame(columns=names)
        for batch in batches:
            row, limit = np.nonzero(batch["weight"].to_numpy()[:, None] >= limits)
            wide = batch.iloc[row].assign(threshold=limits[limit])
            # Earlier settled pairs stand in front, so they close what they hold.
            wide = pd.concat([carried, wide[names]], ignore_index=True) if len(carried) else wide[names].reset_index(drop=True)
            mine, theirs = (wide.groupby([*keys, "threshold", side], dropna=False, sort=False).ngroup().to_numpy() for side in (left, right))
            taken = _settled(mine, theirs)
            yield wide.iloc[taken[taken >= len(carried)]]
            if len(batch):
                last = batch.iloc[-1]
                held = wide.iloc[taken]
                carried = held[np.logical_and.reduce([held[k].isna() if pd.isna(last[k]) else held[k] == last[k] for k in keys])]

    return ordered.mapInPandas(settle, schema)


def _settled(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of the pairs that a greedy pass in the given order takes."""
    free_left, free_right = (np.ones(side.max(initial=-1) + 1, bool) for side in (left, right))
    first_left, first_right = (np.empty(len(side), np.int64) for side in (free_left, free_right))
    still, taken = np.arange(len(left)), []
    while len(still):
        # Written from the back, the earliest place of each side remains.
        first_left[left[still[::-1]]] = still[::-1]
        first_right[right[still[::-1]]] = still[::-1]
        now = still[(first_left[left[still]] == still) & (first_right[right[still]] == still)]
        free_left[left[now]] = False
        free_right[right[now]] = False
        taken.append(now)
        still = still[free_left[left[still]] & free_right[right[still]]]
    return np.sort(np.concatenate(taken)) if taken else still


def match_detections(
    pairs: DataFrame, thresholds: Sequence[float] = IOU_THRESHOLDS,
    keys: Sequence[str] = ("image_id", "class"),
) -> DataFrame:
    """Greedy one-to-one matches in descending score at every threshold."""
    order = [(-F.col("score")).alias("s"), F.col("pred_id").alias("p")]
    return greedy_assign(pairs, keys, "pred_id", "gt_id", order, "iou", thresholds).withColumnRenamed("weight", "iou")


def box_component_overlap(boxes: DataFrame, component_pixels: DataFrame) -> DataFrame:
    """Pixels of each component inside each box of its image and class.

    ``boxes``: image_id, class, ann_id, box (xywh), width, height; pixels: image_id, class,
    component, y, x. Boxes are spread over their rows, so the join is an equi-join per row.
    """
    box = F.col("box")
    rows = boxes.select(
        "image_id", "class", "ann_id",
        F.greatest(F.lit(0), box["x"].cast("int")).alias("_x1"),
        F.least(F.col("width"), F.ceil(box["x"] + box["w"]).cast("int")).alias("_x2"),
        F.greatest(F.lit(0), box["y"].cast("int")).alias("_y1"),
        F.least(F.col("height"), F.ceil(box["y"] + box["h"]).cast("int")).alias("_y2"),
    ).where((F.col("_x2") > F.col("_x1")) & (F.col("_y2") > F.col("_y1")))
    rows = rows.withColumn("y", F.explode(F.sequence(F.col("_y1"), F.col("_y2") - 1)))
    return (
        rows.join(component_pixels, ["image_id", "class", "y"])
        .where((F.col("x") >= F.col("_x1")) & (F.col("x") < F.col("_x2")))
        .groupBy("image_id", "class", "ann_id", "component")
        .agg(F.count(F.lit(1)).alias("overlap"))
    )


def match_boxes_to_components(
    boxes: DataFrame, component_pixels: DataFrame, reuse: bool = False
) -> DataFrame:
    """Component of each box: greatest overlap, in box order, each component once.

    ``reuse`` lets boxes share a component. Boxes without one keep a null component.
    """
    overlap = box_component_overlap(boxes, component_pixels)
    if reuse:
        best = F.max_by(F.struct("component", "overlap"), F.struct(F.col("overlap"), (-F.col("component")).alias("c")))
        found = overlap.groupBy("image_id", "class", "ann_id").agg(best.alias("_b")).select(
            "image_id", "class", "ann_id", F.col("_b.component").alias("component"), F.col("_b.overlap").alias("overlap")
        )
    else:
        found = greedy_assign(
            overlap, ["image_id", "class"], "ann_id", "component", [F.col("ann_id").alias("a")],
            "overlap", (1.0,),
        ).select("image_id", "class", "ann_id", "component", F.col("weight").cast("long").alias("overlap"))
    return boxes.select("image_id", "class", "ann_id").join(found, ["image_id", "class", "ann_id"], "left")
