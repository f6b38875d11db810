"""Sample weights, weighted draws and task mixing for training sets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.operators.catalog import task_samples, union_catalogs
from annolake.operators.order import ranked, running
from annolake.session import spread, stable

EMPTY_SHARE = 0.25
#: Units that the least positive weight of a draw has at least, and digits of the total at most.
LEAST_UNITS, TOTAL_DIGITS = 1_000, 35


def inverse_frequency_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight 1/count of the row's class (M1); counted first, so no class is one window. The counts, one row per class, go to the
    rows: dealt by class, a large class would be one task."""
    counts = df.groupBy(label).agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))
    return df.join(F.broadcast(counts), label)


def multilabel_weights(samples: DataFrame, labels: DataFrame, key: str = "sample_id", label: str = "label") -> DataFrame:
    """Largest 1/instance-count over a sample's labels; empty samples share 0.25 (M2)."""
    # Dealt by sample and counted once, for the class counts and for the weights of the samples.
    held = stable(spread(labels.select(key, label), key).groupBy(key, label).agg(F.count(F.lit(1)).alias("_n")))
    counts = held.groupBy(label).agg((F.lit(1.0) / F.sum("_n")).alias("_w"))
    best = held.select(key, label).join(F.broadcast(counts), label).groupBy(key).agg(F.max("_w").alias("_w"))
    joined = samples.join(best, key, "left")
    empty = joined.agg(F.greatest(F.lit(1), F.count_if(F.col("_w").isNull())))
    return joined.select(
        *samples.columns, F.coalesce("_w", F.lit(EMPTY_SHARE) / empty.scalar()).alias("weight")
    )


def positive_fraction_weights(df: DataFrame, positive: Column, fraction: float) -> DataFrame:
    """Weights that draw positives with the given probability (M3)."""
    if not 0.0 < fraction < 1.0:
        raise ValueError(f"not a share of positive rows: {fraction}")
    flag = F.coalesce(positive, F.lit(False))
    counts = df.agg(F.count_if(flag).alias("p"), F.count_if(~flag).alias("n")).first()
    if not counts["p"] or not counts["n"]:
        raise ValueError("rows of one kind only: nothing to balance")
    return df.withColumn(
        "weight", F.when(flag, F.lit(fraction / counts["p"])).otherwise(F.lit((1.0 - fraction) / counts["n"]))
    )


def weighted_sample(df: DataFrame, n: int, seed: int, key: str, weight: str = "weight", units: int = 1_000_000) -> DataFrame:
    """``n`` draws with replacement, in proportion to the weights, as (draw, row) (M4).

    Weights count in whole ``units``-ths, so sums are exact; where the least positive weight has fewer than ``LEAST_UNITS``
    of these, the units are finer by a power of ten. Every positive weight takes part. A draw's point is the leading 60 bits
    of sha256("seed:draw") modulo the total, 120 bits where the total needs them: the same on any cluster. Rows sit at their
    cumulative weight in key order, and one running count over rows and draws tells how many rows end at or before each draw,
    hence which row it hit.
    """
    value = F.col(weight)
    weighed = df.where((value > 0) & ~F.isnan(value.cast("double")))
    least, most, rows = weighed.agg(F.min(value).cast("double"), F.max(value).cast("double"), F.count(F.lit(1))).first()
    if not rows:
        raise ValueError("no row has a positive weight")
    if math.isinf(most):
        raise ValueError("a weight is infinite")
    finer = math.ceil(max(0.0, math.log10(LEAST_UNITS) - math.log10(units) - math.log10(least)))
    finer = min(finer, math.floor(TOTAL_DIGITS - math.log10(rows) - math.log10(most) - math.log10(units)))
    # Above 10^TOTAL_DIGITS, weights below a unit count as one: their share is less than 120 bits tell.
    counted = F.greatest(F.round(value * (F.lit(units) if not finer else F.lit(float(f"{units}e{finer}")))), F.lit(1))
    narrow = weighed.agg(F.sum(counted.cast("decimal(38,0)"))).first()[0] < 1 << 60
    kind = "long" if narrow else "decimal(38,0)"
    placed = running(weighed.withColumn("_units", counted.cast(kind)), [F.col(key)], sums={"_end": F.col("_units")}, rank="_row").drop("_units")
    placed = placed.withColumn("_end", F.col("_end").cast(kind))
    total = placed.agg(F.max("_end")).first()[0]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast(kind)
    point = part(1) if narrow else (part(1) * F.lit(1 << 60) + part(16)).cast(kind)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(point, F.lit(total).cast(kind)).alias("_end"), F.lit(0).alias("_mark"))
    marks = placed.select(F.lit(None).cast("long").alias("draw"), "_end", F.lit(1).alias("_mark"))
    # At equal points the row end comes first: the draw then belongs to the next row.
    both = running(
        draws.unionByName(marks), [F.col("_end"), F.col("_mark").desc(), F.col("draw")], sums={"_ended": F.col("_mark").cast("long")}
    )
    hits = both.where(F.col("_mark") == 0).select("draw", (F.col("_ended") + 1).alias("_row"))
    return hits.join(placed.drop("_end"), "_row").drop("_row")


def task_schedule(ratios: dict[str, int]) -> list[str]:
    """The tasks of one period, each as evenly spread as its ratio allows.

    Step s (from 1) goes to the task whose due share, s * ratio, is furthest ahead of the steps it has had.
    """
    if not ratios or any(count <= 0 for count in ratios.values()):
        raise ValueError(f"task shares that cannot be scheduled: {ratios}")
    period, steps = sum(ratios.values()), []
    while len(steps) < period:
        due = {task: (len(steps) + 1) * ratio - period * steps.count(task) for task, ratio in ratios.items()}
        steps.append(max(due, key=due.get))
    return steps


def mix_tasks(frames: dict[str, DataFrame], ratios: dict[str, int], steps: int, order: str) -> DataFrame:
    """(step, task, row) over ``steps`` steps, tables starting over when used up (M5)."""
    schedule = [task for task in task_schedule(ratios) if task in frames]
    if not schedule:
        raise ValueError("no scheduled task has a table")
    spark = next(iter(frames.values())).sparkSession
    period = len(schedule)
    share = {task: schedule.count(task) for task in frames}
    # Uses of the task in the earlier steps of its own period.
    turn = [schedule[:i].count(task) for i, task in enumerate(schedule)]
    planned = spark.range(steps).withColumnRenamed("id", "step")
    spot = (F.col("step") % period).cast("int")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), spot)
    planned = planned.withColumn("task", pick(schedule)).withColumn(
        "_use", F.floor(F.col("step") / period) * pick([share[t] for t in schedule]) + pick(turn)
    )
    rows = union_catalogs([
        ranked(frame, [F.col(order)], name="_rank").withColumn("task", F.lit(task))
        for task, frame in frames.items() if share.get(task)
    ])
    sizes = {task: frames[task].count() for task in frames if share.get(task)}
    if not all(sizes.values()):
        raise ValueError(f"empty task table: {sizes}")
    length = F.lit(1)
    for task, size in sizes.items():
        length = F.when(F.col("task") == task, F.lit(size)).otherwise(length)
    planned = planned.withColumn("_rank", F.pmod(F.col("_use"), length) + 1)
    return planned.join(rows, ["task", "_rank"]).drop("_use", "_rank")


def class_index(df: DataFrame, column: str) -> DataFrame:
    """Distinct classes numbered from 0 in alphabetical order (M6)."""
    classes = df.select(column).where(F.col(column).isNotNull()).distinct()
    numbered = ranked(classes, [F.col(column)], name="_rank")
    return numbered.select(column, (F.col("_rank") - 1).cast("int").alias("class_index"))


def build_task_tables(
    catalog: DataFrame, split: str, ring_index: DataFrame, images: DataFrame, crops: DataFrame
) -> DataFrame:
    """Samples of all four tasks in one split; detection tasks skip images with ignore boxes (M7)."""
    clean = images.where(F.coalesce(F.size("ignore_bboxes"), F.lit(0)) <= 0)
    chosen = lambda df: df.where(F.col("split") == split)
    rows = chosen(catalog)
    return union_catalogs([
        task_samples(rows, "ring", ring_index=ring_index),
        task_samples(rows, "defect", images=clean),
        task_samples(rows, "bridge", ring_index=ring_index, images=clean),
        task_samples(rows, "classification", crops=chosen(crops)).drop("category"),
    ])
