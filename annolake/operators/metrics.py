"""Scores of predictions: confusion, IoU, Dice, precision-recall and average precision."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.operators.matching import match_detections
from annolake.operators.order import ranked, running
from annolake.presets import IGNORE_VALUE, IOU_THRESHOLDS
from annolake.session import literal_table, stable


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0 or null."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def _class_table(spark: SparkSession, classes: Sequence, column: str) -> DataFrame:
    kind = pa.int32() if classes and isinstance(classes[0], int) else pa.string()
    return literal_table(spark, [(c,) for c in classes], pa.schema([(column, kind)]))


def confusion_matrix(df: DataFrame, classes: Sequence, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Counts of every (truth, prediction) cell, zeros included."""
    counted = df.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("_n"))
    spark = df.sparkSession
    wanted = _class_table(spark, classes, truth).withColumn(
        pred, F.explode(F.array(*[F.lit(c) for c in classes]))
    )
    return wanted.join(counted, [truth, pred], "left").select(
        truth, pred, F.coalesce("_n", F.lit(0)).alias("cell_count")
    )


def per_class_scores(df: DataFrame, classes: Sequence, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Support, precision, recall, F1 and IoU per class, from one pass over the rows."""
    spark = df.sparkSession
    counted = df.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)
    rows = counted.select(
        F.explode(F.array(
            F.struct(F.col(truth).alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.cast("long").alias("tp")),
            F.struct(F.col(pred).alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
        )).alias("r")
    ).select("r.*")
    summed = rows.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    full = _class_table(spark, classes, "class").join(summed, "class", "left").na.fill(0)
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    scored = full.withColumn("precision", p).withColumn("recall", r)
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.when(p + r > 0, 2.0 * p * r / (p + r)).otherwise(0.0)).withColumn(
        "iou", ratio(F.col("tp"), F.col("support") + F.col("predicted") - F.col("tp"))
    )


def classification_report(df: DataFrame, classes: Sequence, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Accuracy, balanced accuracy and macro F1; a class without support counts as 0."""
    scores = per_class_scores(df, classes, truth, pred)
    return scores.agg(
        ratio(F.sum("tp"), F.greatest(F.lit(1), F.sum("support"))).alias("accuracy"),
        F.avg("recall").alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.sum("support").alias("samples"),
    )


def semantic_iou(df: DataFrame, classes: Sequence[int], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Mean IoU without background and pixel accuracy; targets outside the classes drop out."""
    inside = df.where(F.col(truth).isin(list(classes)))
    scores = per_class_scores(inside, classes, truth, pred)
    return scores.agg(
        F.avg(F.when(F.col("class") > 0, F.col("iou"))).alias("mean_iou"),
        ratio(F.sum("tp"), F.greatest(F.lit(1), F.sum("support"))).alias("pixel_accuracy"),
        F.sum("support").alias("pixels"),
    )


def _pixel_sums() -> list[Column]:
    valid = F.col("valid")
    return [
        F.count_if(valid & F.col("pred") & F.col("target")).alias("hits"),
        (F.count_if(valid & F.col("pred")) + F.count_if(valid & F.col("target"))).alias("total"),
        F.count_if(valid & F.col("target")).alias("target_pixels"),
        F.count_if(valid).alias("valid_pixels"),
        F.sum(F.when(valid, F.abs(F.col("pred_distance") - F.col("target_distance")))).alias("error"),
    ]


def ring_scores(pixels: DataFrame) -> DataFrame:
    """Mean over images of boundary Dice and of distance error on valid pixels.

    ``pixels``: image_id, valid, pred, target (booleans), pred_distance, target_distance.
    """
    per_image = pixels.groupBy("image_id").agg(*_pixel_sums())
    dice = F.when(F.col("total") > 0, 2.0 * F.col("hits") / F.col("total")).otherwise(0.0)
    return per_image.agg(
        F.coalesce(F.avg(dice), F.lit(0.0)).alias("boundary_dice"),
        F.coalesce(F.avg(F.when(F.col("valid_pixels") > 0, F.col("error") / F.col("valid_pixels"))), F.lit(0.0)).alias("distance_mae"),
        F.count(F.lit(1)).alias("images"),
    )


def regional_ring_scores(pixels: DataFrame, region: str = "region") -> DataFrame:
    """Macro and micro Dice and pixel-weighted error per region."""
    per_image = pixels.groupBy(region, "image_id").agg(*_pixel_sums()).where(F.col("valid_pixels") > 0)
    return per_image.groupBy(region).agg(
        F.coalesce(F.avg(F.when(F.col("total") > 0, 2.0 * F.col("hits") / F.col("total"))), F.lit(0.0)).alias("boundary_dice_macro"),
        ratio(2.0 * F.sum("hits"), F.sum("total")).alias("boundary_dice_micro"),
        ratio(F.sum("error"), F.sum("valid_pixels")).alias("distance_mae"),
        F.count(F.lit(1)).alias("evaluated_images"),
        F.count_if(F.col("total") > 0).alias("informative_images"),
        F.sum("valid_pixels").alias("valid_pixels"),
        F.sum("target_pixels").alias("target_boundary_pixels"),
    )


def cumulative_pr(records: DataFrame, gt_counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running true and false positives, precision and recall by falling score.

    ``records``: keys, pred_id, score, tp (0/1); ``gt_counts``: keys, npos.
    """
    keys = list(keys)
    curve = running(
        records.select(*keys, "pred_id", "score", "tp"), [F.col("score").desc(), F.col("pred_id")], keys, rank="seen", sums={"tp_run": F.col("tp").cast("long")}
    ).join(gt_counts, keys)
    return (
        curve.withColumn("fp_run", F.col("seen") - F.col("tp_run"))
        .withColumn("precision", F.col("tp_run") / F.greatest(F.lit(1), F.col("seen")).cast("double"))
        .withColumn("recall", F.col("tp_run") / F.greatest(F.lit(1), F.col("npos")).cast("double"))
    )


def average_precision_101(curve: DataFrame, gt_counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over 101 recall levels of the best precision at or beyond the level."""
    keys = list(keys)
    guess = F.floor(F.col("recall") * 100).cast("int")
    at = lambda k: k.cast("double") * 0.01
    level = (
        F.when(at(guess + 1) <= F.col("recall"), guess + 1)
        .when(at(guess) > F.col("recall"), guess - 1).otherwise(guess)
    )
    peaks = curve.groupBy(*keys, F.least(level, F.lit(100)).alias("_level")).agg(F.max("precision").alias("_p"))
    # At most 101 levels per key meet here.
    listed = peaks.groupBy(*keys).agg(F.collect_list(F.struct("_level", "_p")).alias("_peaks"))
    best = F.transform(
        F.sequence(F.lit(0), F.lit(100)),
        lambda k: F.coalesce(
            F.array_max(F.transform(F.filter("_peaks", lambda e: e["_level"] >= k), lambda e: e["_p"])), F.lit(0.0)
        ),
    )
    ap = F.aggregate(best, F.lit(0.0), lambda s, v: s + v) / 101.0
    return gt_counts.join(listed, keys, "left").select(
        *keys, "npos",
        F.when((F.col("npos") > 0) & F.col("_peaks").isNotNull(), ap).otherwise(0.0).alias("ap"),
    )


def average_precision_area(curve: DataFrame, gt_counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under the precision envelope.

    Recall moves only at true positives, by 1/npos each, and precision peaks there, so the
    area is the mean over positives of the best precision from that hit on.
    """
    keys = list(keys)
    hits = curve.where(F.col("tp") == 1).select(*keys, "tp_run", "precision")
    envelope = running(hits, [F.col("tp_run").desc()], keys, maxima={"envelope": F.col("precision")})
    area = envelope.groupBy(*keys).agg(F.sum("envelope").alias("_area"))
    return gt_counts.join(area, keys, "left").select(
        *keys, "npos", F.coalesce(ratio(F.col("_area"), F.col("npos")), F.lit(0.0)).alias("ap")
    )


def detection_curves(preds: DataFrame, gts: DataFrame, matches: DataFrame, thresholds: Sequence[float] = IOU_THRESHOLDS) -> tuple[DataFrame, DataFrame]:
    """Curve rows at the true positives, and truths per class, for each threshold.

    A prediction's place in its class is the same at every threshold, so predictions are
    ranked once; only matched ones are repeated per threshold.
    """
    place = ranked(
        preds.select("image_id", "class", "pred_id", "score"), [F.col("score").desc(), F.col("pred_id")], ["class"], "seen"
    )
    hits = matches.select("image_id", "class", "threshold", "pred_id").join(place, ["image_id", "class", "pred_id"])
    counted = running(hits, [F.col("seen")], ["class", "threshold"], rank="tp_run")
    limits = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    npos = gts.groupBy("class").agg(F.count(F.lit(1)).alias("npos")).select("class", "npos", limits)
    curve = counted.join(npos, ["class", "threshold"]).select(
        "class", "threshold", "tp_run", "seen", F.lit(1).alias("tp"),
        (F.col("tp_run") / F.col("seen").cast("double")).alias("precision"),
        (F.col("tp_run") / F.col("npos").cast("double")).alias("recall"),
    )
    return curve, npos


def detection_report(
    preds: DataFrame, gts: DataFrame, pairs: DataFrame, thresholds: Sequence[float] = IOU_THRESHOLDS, area: bool = False, kind: str = "box",
) -> DataFrame:
    """Per kind and class: support, AP50-95, AP50 and recall at 0.5.

    ``pairs`` may come from boxes (``iou_pairs``) or from masks (``mask_pairs``, whose scores are those of ``preds``).
    """
    if "score" not in pairs.columns:
        pairs = pairs.join(preds.select("image_id", "class", "pred_id", "score"), ["image_id", "class", "pred_id"])
    matches = stable(match_detections(pairs, thresholds))
    curve, npos = detection_curves(preds, gts, matches, thresholds)
    keys = ["class", "threshold"]
    ap = (average_precision_area if area else average_precision_101)(curve, npos, keys)
    recall = curve.groupBy(*keys).agg(F.max("recall").alias("recall"))
    full = ap.join(recall, keys, "left")
    low = F.col("threshold") == float(thresholds[0])
    return full.groupBy(F.lit(kind).alias("kind"), "class").agg(
        F.max("npos").alias("support"), F.avg("ap").alias("ap50_95"),
        F.max(F.when(low, F.col("ap"))).alias("ap50"),
        F.coalesce(F.max(F.when(low, F.col("recall"))), F.lit(0.0)).alias("recall50"),
    )


def detection_means(report: DataFrame) -> DataFrame:
    """mAP50-95, mAP50 and mean recall over classes that have truths, of a report of one kind."""
    held = report.where(F.col("support") > 0)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return held.agg(
        mean("ap50_95").alias("map50_95"), mean("ap50").alias("map50"), mean("recall50").alias("macro_recall50")
    )


def pair_scores(joined: DataFrame, keys: Sequence[str]) -> DataFrame:
    """IoU and Dice of pairs with inter, pred_area and gt_area."""
    total = F.col("pred_area") + F.col("gt_area")
    return joined.select(
        *keys, "pred_id", "gt_id",
        (F.col("inter") / F.greatest(F.lit(1), total - F.col("inter")).cast("double")).alias("iou"),
        (2.0 * F.col("inter") / F.greatest(F.lit(1), total)).alias("dice"),
    )


def mask_pairs(pred_pixels: DataFrame, gt_pixels: DataFrame, keys: Sequence[str] = ("image_id", "class")) -> DataFrame:
    """IoU and Dice of every overlapping mask pair, from shared pixels."""
    keys = list(keys)
    inter = pred_pixels.select(*keys, "y", "x", "pred_id").join(
        gt_pixels.select(*keys, "y", "x", "gt_id"), [*keys, "y", "x"]
    ).groupBy(*keys, "pred_id", "gt_id").agg(F.count(F.lit(1)).alias("inter"))
    pa_ = pred_pixels.groupBy(*keys, "pred_id").agg(F.count(F.lit(1)).alias("pred_area"))
    ga = gt_pixels.groupBy(*keys, "gt_id").agg(F.count(F.lit(1)).alias("gt_area"))
    joined = inter.join(pa_, [*keys, "pred_id"]).join(ga, [*keys, "gt_id"])
    return pair_scores(joined, keys)


def mask_quality(pairs: DataFrame, preds: DataFrame, gts: DataFrame, min_score: float = 0.25) -> DataFrame:
    """Per class, mean over truths of the best kept prediction's IoU and its Dice."""
    kept = preds.where(F.col("score") >= min_score).select("image_id", "class", "pred_id", "score")
    best = (
        pairs.join(kept, ["image_id", "class", "pred_id"])
        .groupBy("image_id", "class", "gt_id")
        .agg(F.max_by(F.struct("iou", "dice"), F.struct("iou", "score", "pred_id")).alias("_b"))
    )
    per_gt = gts.select("image_id", "class", "gt_id").join(best, ["image_id", "class", "gt_id"], "left")
    mean = lambda field: F.avg(F.coalesce(F.col(f"_b.{field}"), F.lit(0.0)))
    return per_gt.groupBy("class").agg(
        F.count(F.lit(1)).alias("support"), mean("iou").alias("gt_best_mask_iou"), mean("dice").alias("gt_best_mask_dice")
    )


def mask_quality_means(quality: DataFrame) -> DataFrame:
    """Mean over classes of the per-class mask quality."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    return quality.agg(mean("gt_best_mask_iou"), mean("gt_best_mask_dice"))


def weighted_score(metrics: DataFrame, weights: dict[str, float], keys: Sequence[str] = (), known: Sequence[str] | None = None) -> DataFrame:
    """Sum of weight times metric value, an absent metric counting 0.

    ``metrics``: keys, metric, value. A weight for an unknown metric is an error.
    """
    unknown = sorted(set(weights) - set(known)) if known is not None else []
    if unknown:
        raise ValueError(f"no such part of the score: {unknown}")
    factor = F.lit(0.0)
    for name, weight in weights.items():
        factor = F.when(F.col("metric") == name, F.lit(float(weight))).otherwise(factor)
    return metrics.groupBy(*keys).agg(F.sum(factor * F.coalesce("value", F.lit(0.0))).alias("score"))


def best_epoch(history: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Highest score per run; the latest epoch wins ties."""
    pick = F.max_by(F.struct("epoch", "score"), F.struct("score", "epoch")).alias("_b")
    rows = history.where(F.col("score").isNotNull()).groupBy(*keys).agg(pick)
    return rows.select(*keys, F.col("_b.epoch").alias("epoch"), F.col("_b.score").alias("score"))


def drop_ignored(df: DataFrame, truth: str = "truth") -> DataFrame:
    return df.where(F.col(truth) != IGNORE_VALUE)
