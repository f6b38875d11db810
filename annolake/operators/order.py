"""Ordered work without a single-task window: global ranks, running totals, ordered digests.

A window over a whole table or over a hot key runs in one task. Here rows are range
partitioned on (keys, order), each partition is scanned on its own, and the totals of the
partitions before it are added. At most one key per partition began in an earlier
partition, so the table of carried totals never has more rows than there are partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolake.session import shuffle_partitions, stable

DIGEST_FAN_IN = 4_096


def running(
    df: DataFrame,
    order: Sequence[Column],
    keys: Sequence[str] = (),
    rank: str | None = None,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add running row numbers, sums and maxima per ``keys`` in ``order``.

    ``order`` must be total within a key, so that results do not depend on task order.
    """
    keys = list(keys)
    measures: dict[str, tuple[str, Column]] = {}
    if rank:
        measures[rank] = ("sum", F.lit(1).cast("long"))
    measures.update({name: ("sum", value) for name, value in (sums or {}).items()})
    measures.update({name: ("max", value) for name, value in (maxima or {}).items()})
    combine = {"sum": F.sum, "max": F.max}

    sorting = [F.col(key) for key in keys] + list(order)
    parts = partitions or shuffle_partitions(df)
    placed = df
    for name, (_, value) in measures.items():
        placed = placed.withColumn(f"_in_{name}", value)
    placed = stable(
        placed.repartitionByRange(parts, *sorting).withColumn("_part", F.spark_partition_id())
    )

    inside = (
        Window.partitionBy("_part", *keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = placed
    for name, (how, _) in measures.items():
        local = local.withColumn(f"_run_{name}", combine[how](f"_in_{name}").over(inside))

    totals = placed.groupBy("_part", *keys).agg(
        *[combine[how](f"_in_{name}").alias(f"_sum_{name}") for name, (how, _) in measures.items()]
    )
    before = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.withColumn("_first", F.min("_part").over(before))
    for name, (how, _) in measures.items():
        carried = carried.withColumn(f"_carry_{name}", combine[how](f"_sum_{name}").over(before))
    carried = carried.where(F.col("_first").isNotNull()).select(
        F.col("_part").alias("_cpart"),
        *[F.col(key).alias(f"_c_{key}") for key in keys],
        *[f"_carry_{name}" for name in measures],
    )
    match = F.col("_part") == F.col("_cpart")
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_c_{key}"))
    joined = local.join(F.broadcast(carried), match, "left")

    result = [F.col(name) for name in df.columns]
    for name, (how, _) in measures.items():
        carry, run = F.col(f"_carry_{name}"), F.col(f"_run_{name}")
        if how == "sum":
            value = F.coalesce(carry, F.lit(0)) + F.coalesce(run, F.lit(0))
        else:
            value = F.greatest(carry, run)
        result.append(value.alias(name))
    return joined.select(*result)


def ranked(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Row number from 1 per ``keys`` in a total ``order``, spread over all tasks."""
    return running(df, order, keys, rank=name)


def ordered_digest(
    df: DataFrame,
    order: Sequence[Column],
    line: Column,
    keys: Sequence[str] = (),
    name: str = "tree_sha256",
    sums: dict[str, Column] | None = None,
    fan_in: int = DIGEST_FAN_IN,
) -> DataFrame:
    """Tree digest of the ordered lines of each key group, with their count and sums over the same rows.

    Three levels at every size: a leaf is the SHA-256 of ``fan_in`` lines joined together, a node that of ``fan_in``
    leaf digests, the root that of all node digests. A group of one line has one leaf, one node and the root.
    """
    keys = list(keys)
    totals = {"lines": F.count(F.lit(1)), **{n: F.coalesce(F.sum(value), F.lit(0)) for n, value in (sums or {}).items()}}
    level = (
        ranked(df.withColumn("_line", line), order, keys, "_rank")
        .groupBy(*keys, F.expr(f"(_rank - 1) div {int(fan_in)}").alias("_at"))
        .agg(F.expr("sha2(listagg(_line, '') within group (order by _rank), 256)").alias("_digest"),
             *[value.alias(total) for total, value in totals.items()])
    )
    joined = F.expr("sha2(listagg(_digest, '') within group (order by _at), 256)")
    sums_of = [F.sum(total).alias(total) for total in totals]
    nodes = level.groupBy(*keys, F.expr(f"_at div {int(fan_in)}").alias("_up")).agg(joined.alias("_digest"), *sums_of)
    return nodes.withColumnRenamed("_up", "_at").groupBy(*keys).agg(joined.alias(name), *sums_of)


def ordered_output(df: DataFrame, *keys: str) -> DataFrame:
    """Globally sorted rows."""
    return df.orderBy(*keys)


def head(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """First ``n`` rows in key order; ``n <= 0`` keeps every row."""
    ordered = df.orderBy(*keys) if keys else df
    return ordered if n <= 0 else ordered.limit(n)


def preview(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """Total count and the first ``k`` values in order, joined by comma."""
    first = df.select(column).orderBy(column).limit(k)
    joined = first.agg(F.array_join(F.array_sort(F.collect_list(column)), ", "))
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", joined.scalar().alias("preview")
    )


def first_match(df: DataFrame, predicate: Column, *keys: str) -> DataFrame:
    """First row in key order that satisfies the predicate (T4)."""
    return df.where(predicate).orderBy(*keys).limit(1)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the earliest row of each key (W6) by partial aggregation, not by sorting groups."""
    rest = [name for name in df.columns if name not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*keys, *[F.col(f"_row.{name}").alias(name) for name in rest]).select(*df.columns)


def least_per_key(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key, the least by its other columns in their order, so that a rerun keeps the same one."""
    rest = [name for name in df.columns if name not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def even_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``n`` rows at evenly spaced positions of the key order; all rows if there are fewer."""
    if n <= 0:
        return df
    total = df.count()
    if total <= n:
        return df
    row = F.col("_rank") - 1
    if n == 1:
        keep = row == 0
    else:
        # Position i is floor(i * step) in doubles, the last one exactly the final row.
        step = (total - 1) / (n - 1)
        guess = F.ceil(row / F.lit(step))
        hits = [
            (i >= 0) & (i < n - 1) & (F.floor(i.cast("double") * F.lit(step)) == row)
            for i in (guess - 1, guess, guess + 1)
        ]
        keep = hits[0] | hits[1] | hits[2] | (row == total - 1)
    return ranked(df, [F.col(key) for key in keys], name="_rank").where(keep).drop("_rank")
