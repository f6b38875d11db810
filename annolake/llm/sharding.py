"""Sampled splitters: documents in key order, cut into shards of near equal bytes.

1. A sample of keys, drawn with odds in proportion to row size, gives the quantile boundaries of ``ranges`` key ranges.
2. Exact bytes and rows per range are counted. A range above twice its share is subdivided by a sample of its own.
3. Rows go to their range's task, are sorted there, and the running bytes place each row: a shard boundary may fall inside
   a range, so shards differ by at most about one row's size, whatever the sample was like.

The key is (hash of the text, doc_id): equal texts lie side by side, and a group of copies larger than a range is still
split, by doc_id. Only samples and range totals reach the driver: ``ranges * SAMPLES_PER_RANGE`` keys and a row per range.

Defined cases: null text has size 1; null doc_id comes before the other ids of its text; repeated rows take slots of their
own; an empty table gives an empty table; input columns named like a result column are replaced.
"""

from __future__ import annotations

import bisect
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolake.session import stable

SHARDS = 16
RANGE_BYTES = 32 << 20
LEAST_RANGES, MOST_RANGES = 64, 16_384
SAMPLES_PER_RANGE = 24
ROUNDS = 4


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus 1."""
    return (F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) + 1).cast("long")


def _key() -> Column:
    text = F.lpad(F.hex(F.xxhash64(F.col("text"))), 16, "0")
    return F.concat(text, F.coalesce(F.lpad(F.hex(F.col("doc_id").cast("long")), 16, "0"), F.lit("")))


def weighted_sample(keyed: DataFrame, size: int, seed: int) -> list[str]:
    """Keys of ``size`` rows drawn by size: the least values of -ln(u) / weight."""
    u = (F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52) + 2)
    rows = keyed.select("_key", (-F.log(u) / F.col("_size")).alias("_u")).orderBy("_u", "_key").limit(size).collect()
    return sorted(row["_key"] for row in rows)


def _quantiles(sample: list[str], parts: int) -> list[str]:
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


def _range_of(splitters: list[str]) -> Column:
    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return keys.map(lambda key: bisect.bisect_right(splitters, key)).astype("int32")

    return place("_key")


def splitters_of(keyed: DataFrame, range_bytes: int = RANGE_BYTES) -> list[str]:
    """Range boundaries such that no range that can be split holds much more than its share."""
    total = keyed.agg(F.sum("_size").alias("bytes")).first()["bytes"] or 0
    ranges = min(MOST_RANGES, max(LEAST_RANGES, math.ceil(total / range_bytes)))
    share = max(1, total / ranges)
    splitters = _quantiles(weighted_sample(keyed, ranges * SAMPLES_PER_RANGE, 1), ranges)
    for round_ in range(2, 2 + ROUNDS):
        placed = keyed.withColumn("_range", _range_of(splitters))
        totals = placed.groupBy("_range").agg(F.sum("_size").alias("bytes"), F.min("_key").alias("a"), F.max("_key").alias("b"))
        over = [row for row in totals.where(F.col("bytes") > 2 * share).collect() if row["a"] < row["b"]]
        added = set()
        parts = {row["_range"]: math.ceil(row["bytes"] / share) for row in over}
        if parts:
            inside = weighted_sample(placed.where(F.col("_range").isin(list(parts))), sum(parts.values()) * SAMPLES_PER_RANGE, round_)
            for range_, n in parts.items():
                low = splitters[range_ - 1] if range_ else ""
                high = splitters[range_] if range_ < len(splitters) else None
                own = [key for key in inside if key >= low and (high is None or key < high)]
                added.update(_quantiles(own, n))
        if not added - set(splitters):
            break
        splitters = sorted(added | set(splitters))
    return splitters


def assign_shards(docs: DataFrame, shards: int = SHARDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``docs`` with size (long), shard (int, 0 on) and slot (long, gapless from 0 in each shard, in key order)."""
    narrow = stable(docs.select(_key().alias("_key"), row_size(F.col("text")).alias("_size")))
    splitters = splitters_of(narrow, range_bytes)
    placed = narrow.withColumn("_range", _range_of(splitters))
    sums = {row["_range"]: (row["bytes"], row["n"]) for row in placed.groupBy("_range").agg(
        F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
    before, rows_before, at, rows_at = [], [], 0, 0
    for range_ in range(len(splitters) + 1):
        before.append(at)
        rows_before.append(rows_at)
        at, rows_at = at + sums.get(range_, (0, 0))[0], rows_at + sums.get(range_, (0, 0))[1]
    total = max(1, at)

    def offset(values: list[int]) -> Column:
        return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), F.col("_range"))

    inside = Window.partitionBy("_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def shard_of(df: DataFrame) -> DataFrame:
        # The shard in which the middle of the row's bytes falls; doubled to stay with whole numbers.
        df = df.withColumn("_end", F.sum("_size").over(inside) + offset(before)).withColumn(
            "_row", F.count(F.lit(1)).over(inside) + offset(rows_before) - 1)
        middle = (F.col("_end").cast("decimal(38,0)") * 2 - F.col("_size")) * shards
        return df.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle / F.lit(2 * total).cast("decimal(38,0)")).cast("int")))

    first = {row["shard"]: row["row"] for row in shard_of(placed).groupBy("shard").agg(F.min("_row").alias("row")).collect()}
    firsts = F.split(F.lit(",".join(str(first.get(s, 0)) for s in range(shards))), ",").cast("array<bigint>")
    kept = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    full = docs.select(F.struct(*kept).alias("_doc"), _key().alias("_key"), row_size(F.col("text")).alias("_size"))
    return shard_of(full.withColumn("_range", _range_of(splitters))).select(
        *[F.col("_doc").getField(c).alias(c) for c in kept], F.col("_size").alias("size"), "shard", (F.col("_row") - F.get(firsts, F.col("shard"))).alias("slot"))
