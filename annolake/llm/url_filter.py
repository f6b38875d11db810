"""Bloom filter cascade: exact membership of the corpus's keys in a list, without a join.

Level 0 encodes the listed keys, level 1 the unlisted keys of the corpus that level 0 wrongly holds, level 2 the listed keys
that level 1 wrongly holds, and so on until no key is wrong. A key's class is then the parity of the first level that
does not hold it, exact for every key of the universe the cascade was built over: all distinct keys of the corpus.

The key space is cut into slices by a hash, so that no filter of listed keys is above ``slice_bytes``. A filter of wrongly held keys has
under 1 in 100 of the slice's unlisted keys, so it is larger only where a corpus has over a hundred times as many keys as are listed.
One slice is broadcast and tested row by row; with more, verdicts are found for the distinct keys slice by slice, one broadcast at a
time, and joined to the rows.

Defined cases: a null url, or one without ``://``, has an empty host and path; the empty host is a key like any other; null keys
are members of nothing; repeated rows are judged each; with no listed key there is no member; an empty table gives an
empty table; input columns named like a result column are replaced.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.session import stable

BITS_PER_KEY, HASHES = 10, 7
SLICE_BYTES = 32 << 20
MOST_LEVELS = 64


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], part: int) -> Column:
    """Part 0: the text, part 1: the verdict of the longest fitting rule (host, path, verdict); null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0], r[1]))
    picks = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit((h + p, verdict)[part]))
        for h, p, verdict in ordered]
    return F.coalesce(*picks)


def _hashes(key: Column, level: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * level + 1), key), F.xxhash64(F.lit(2 * level + 2), key)]


def _positions(first: np.ndarray, second: np.ndarray, bits: int) -> list[np.ndarray]:
    a, b = first.astype(np.uint64), second.astype(np.uint64) | np.uint64(1)
    return [(a + np.uint64(i) * b) % np.uint64(bits) for i in range(HASHES)]


def _inside(bitmap: np.ndarray, bits: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [
        bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
        for at in _positions(first, second, bits)])


class Cascade:
    """Filters by slice and level; ``levels[s][j]`` is (bits, bitmap)."""

    def __init__(self, levels: list[list[tuple[int, np.ndarray]]], keys: DataFrame) -> None:
        self.levels, self.keys = levels, keys

    def _slice(self, key: Column, number: int) -> Column:
        filters = self.levels[number]
        if not filters:
            return F.lit(False)
        held = self.keys.sparkSession.sparkContext.broadcast(filters)

        @F.pandas_udf("boolean")
        def member(hashes: pd.DataFrame) -> pd.Series:
            # Walk the levels until one does not hold the key; held by all: the class that the last one encodes.
            open_, verdict = np.ones(len(hashes), bool), np.full(len(hashes), len(held.value) % 2 == 1)
            for level, (bits, bitmap) in enumerate(held.value):
                inside = _inside(bitmap, bits, *(hashes.iloc[:, 2 * level + i].to_numpy(np.int64) for i in (0, 1)))
                verdict[open_ & ~inside] = level % 2 == 1
                open_ &= inside
            return pd.Series(verdict)

        return member(F.struct(*[
            h.alias(f"h{level}_{i}") for level in range(len(filters)) for i, h in enumerate(_hashes(key, level))]))

    def mark(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """``df`` with boolean ``name``: is ``key``, a key of the universe, listed?"""
        if len(self.levels) == 1:
            return df.withColumn(name, F.col(key).isNotNull() & self._slice(F.col(key), 0))
        parts = []
        for number in range(len(self.levels)):
            own = self.keys.where(F.col("_slice") == number)
            parts.append(stable(own.select(F.col("key").alias("_key"), self._slice(F.col("key"), number).alias(name))))
        verdicts = reduce(DataFrame.unionAll, parts)
        return df.join(verdicts, df[key] == verdicts["_key"], "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_key")


def _bitmap(keys: DataFrame, level: int, count: int) -> tuple[int, np.ndarray]:
    """The filter of ``keys``; the bits of a byte are or-ed where the keys are, a row per non-zero byte reaches the driver."""
    bits = max(64, BITS_PER_KEY * count)
    first, second = _hashes(F.col("key"), level)

    @F.pandas_udf("array<long>")
    def places(a: pd.Series, b: pd.Series) -> pd.Series:
        at = np.stack(_positions(a.to_numpy(np.int64), b.to_numpy(np.int64), bits), axis=1).astype(np.int64)
        return pd.Series(list(at))

    one = keys.select(F.explode(places(first, second)).alias("p")).select(
        F.shiftright("p", 3).alias("byte"), F.expr("shiftleft(1, cast(p & 7 as int))").alias("bit"))
    table = one.groupBy("byte").agg(F.bit_or("bit").alias("v")).toArrow()
    bitmap = np.zeros((bits + 7) // 8, np.uint8)
    bitmap[table.column("byte").to_numpy()] = table.column("v").to_numpy().astype(np.uint8)
    return bits, bitmap


def build_cascade(keys: DataFrame, listed: DataFrame, slice_bytes: int = SLICE_BYTES) -> Cascade:
    """Over the universe ``keys`` (column key, any repeats) and the ``listed`` keys (column key)."""
    universe = keys.where("key is not null").distinct()
    marked = universe.join(listed.select("key").where("key is not null").distinct().withColumn("_in", F.lit(True)), "key", "left")
    total = listed.count()
    slices = max(1, math.ceil(total * BITS_PER_KEY / 8 / slice_bytes))
    marked = stable(marked.select(
        "key", F.coalesce("_in", F.lit(False)).alias("listed"), F.pmod(F.xxhash64(F.lit(0), "key"), F.lit(slices)).cast("int").alias("_slice")))
    cascade = Cascade([[] for _ in range(slices)], marked)
    for number in range(slices):
        own = marked.where(F.col("_slice") == number)
        encode, test = own.where("listed"), own.where("not listed")
        for level in range(MOST_LEVELS):
            count = encode.count()
            if not count:
                break
            cascade.levels[number].append(_bitmap(encode, level, count))
            # Of the other class, those that every level so far holds go on.
            wrong = stable(test.where(_holds(cascade, number, level)))
            encode, test = wrong, encode
        else:
            raise RuntimeError("the cascade does not end")
    return cascade


def _holds(cascade: Cascade, number: int, level: int) -> Column:
    """Does the newest level hold the key?"""
    bits, bitmap = cascade.levels[number][level]
    held = cascade.keys.sparkSession.sparkContext.broadcast(bitmap)
    first, second = _hashes(F.col("key"), level)

    @F.pandas_udf("boolean")
    def inside(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_inside(held.value, bits, a.to_numpy(np.int64), b.to_numpy(np.int64)))

    return inside(first, second)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``pages`` (with url) plus host, path, rule and verdict: the longest rule's, else block where the host is listed."""
    host, path = url_parts(F.col("url"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(*kept).alias("_page"), host.alias("host"), path.alias("path"))
    cascade = build_cascade(rows.select(F.col("host").alias("key")), listed, slice_bytes)
    marked = cascade.mark(rows, "host", "_listed")
    return marked.select(
        *[F.col("_page").getField(c).alias(c) for c in kept], "host", "path", longest_rule(F.col("host"), F.col("path"), rules, 0).alias("rule"),
        F.coalesce(
            longest_rule(F.col("host"), F.col("path"), rules, 1),
            F.when(F.col("_listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
