"""Periodic runs of words by seeds and extensions along diagonals.

A run is a stretch of words with smallest period q and at least max(``LEAST_LENGTH``, 2q) words that no neighbouring word
extends. Its words and those q places later agree over at least max(q, ``LEAST_LENGTH`` - q) places, so for lags below 12 any
run holds two equal 6-grams one lag apart, and for lags from k to 2k - 1 (k = 12, 24, 48, ...) two equal k-grams: these are
the k-grams of minimum guaranteed overlap. They are numbered exactly, each length from the numbers of half that length, and
only where both halves repeat, so plain prose drops out at once.

Pairs of occurrences in one document are the seeds. Seeds are sorted by lag and place; one that lies within what its lag has
covered so far starts no extension. The others are extended both ways along their diagonal, by the longest known k-grams
first. From 12 words on, occurrences of a k-gram at most k/2 apart lie in one run of a shorter period; such a chain meets
other chains by its first and last member only, as every run between two chains holds one of these. So seeds and
extensions stay near n log n, also for a text of one repeated word.

Whole texts are worked on in Arrow batches where they lie, without any shuffle; a long document is never cut.

Defined cases: null and blank texts have no words, no runs and an empty rest; words are parted by the six ASCII blanks and
compared byte by byte; null doc_ids and repeated rows are kept, each row by itself; an empty table gives an empty table;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.llm.text import words

LEAST_LENGTH, SEED = 12, 6
SLICE_CHARS = 2 << 20
RUNS_DDL = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class _Grams:
    """Numbers of repeated k-grams at every place; -1 where the k-gram is found once in its document."""

    def __init__(self, codes: np.ndarray, docs: np.ndarray) -> None:
        self.n = len(codes)
        self.of: dict[int, np.ndarray] = {}
        self._number(1, np.arange(self.n), docs.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes)

    def _number(self, k: int, places: np.ndarray, keys: np.ndarray) -> None:
        out = np.full(self.n + 1, -1, np.int32)
        if len(keys):
            _, number, times = np.unique(keys, return_inverse=True, return_counts=True)
            again = times[number] > 1
            renumbered = np.cumsum(times > 1) - 1
            out[places[again]] = renumbered[number[again]]
        self.of[k] = out

    def join(self, a: int, b: int) -> bool:
        """Number the (a+b)-grams from a- and b-grams; False if none repeats."""
        first, second = self.of[a], self.of[b]
        places = np.flatnonzero(first >= 0)
        places = places[places + a < self.n]
        places = places[second[places + a] >= 0]
        self._number(a + b, places, first[places].astype(np.int64) * (int(second.max()) + 1) + second[places + a])
        return bool((self.of[a + b] >= 0).any())

    def extend(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        """How many words agree from places a and b on, forward (1), or before them, backward (-1)."""
        a, b, done = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in sorted(self.of, reverse=True):
            number = self.of[k]
            while True:
                x, y = (a, b) if way > 0 else (a - k, b - k)
                seen = number[np.maximum(x, 0)]
                same = (x >= 0) & (seen >= 0) & (seen == number[np.maximum(y, 0)])
                if not same.any():
                    break
                step = np.where(same, k, 0)
                a, b, done = a + way * step, b + way * step, done + step
        return done


def _between(lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every range low to high - 1: its number and each member."""
    sizes = np.maximum(highs - lows, 0)
    owner = np.repeat(np.arange(len(lows)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lows[owner]


def _seeds(number: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and lag of the occurrence pairs of k-grams that may lie in a run of this class of lags."""
    least, most = (1 if k == SEED else k), 2 * k
    places = np.flatnonzero(number >= 0)
    wide = n + most + 1
    keys = np.sort(number[places].astype(np.int64) * wide + places)
    at = keys % wide
    if k == SEED:
        ends, starts = np.arange(len(keys)), np.zeros(0, np.int64)
    else:
        apart = np.diff(keys) > k // 2
        ends, starts = np.flatnonzero(np.append(apart, True)), np.flatnonzero(np.append(True, apart))
    after, later = _between(np.searchsorted(keys, keys[ends] + least), np.searchsorted(keys, keys[ends] + most))
    before, earlier = _between(
        np.searchsorted(keys, keys[starts] - most, "right"), np.searchsorted(keys, keys[starts] - least, "right"))
    first = np.concatenate((at[ends][after], at[earlier]))
    second = np.concatenate((at[later], at[starts][before]))
    return first, second - first


def find_runs(codes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of all runs, by start and period; ``codes`` numbers the words, ``docs`` their documents in order."""
    grams, n = _Grams(codes, docs), len(codes)
    found = [np.zeros((0, 3), np.int64)]
    k = SEED
    more = n > 0 and grams.join(1, 1) and grams.join(2, 1) and grams.join(3, 3)
    while more:
        more = grams.join(k, k)
        place, lag = _seeds(grams.of[k], k, n)
        keys = np.unique(lag * (n + 1) + place)
        lag, place = np.divmod(keys, n + 1)
        covered = np.concatenate(([False], (np.diff(lag) == 0) & (place[1:] <= place[:-1] + k))) if len(keys) else np.zeros(0, bool)
        found.append(np.stack((place[~covered], lag[~covered], np.zeros(int((~covered).sum()), np.int64)), axis=1))
        k *= 2
    place, lag, _ = np.concatenate(found).T
    back = grams.extend(place, place + lag, -1)
    length = back + grams.extend(place, place + lag, 1) + lag
    start = place - back
    fit = length >= np.maximum(LEAST_LENGTH, 2 * lag)
    start, length, lag = start[fit], length[fit], lag[fit]
    # Of several periods over one and the same stretch the least one is its period, the others are multiples.
    order = np.lexsort((lag, length, start))
    start, length, lag = start[order], length[order], lag[order]
    same = np.concatenate(([False], (np.diff(start) == 0) & (np.diff(length) == 0))) if len(start) else np.zeros(0, bool)
    start, length, lag = start[~same], length[~same], lag[~same]
    order = np.lexsort((lag, start))
    return start[order], length[order], lag[order]


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    """The texts of a batch, a few megabytes at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        done = sizes[at - 1] if at else 0
        until = max(at + 1, int(np.searchsorted(sizes, done + SLICE_CHARS, "right")))
        yield column.slice(at, until - at)
        at = until


def _worked(texts: pa.Array) -> list[pa.Array]:
    """n_words, runs and collapsed of some texts."""
    cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = cut.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(cut).to_numpy(zero_copy_only=False))
    owner, flat = owner[real.to_numpy(zero_copy_only=False)], flat.filter(real)
    counts = np.bincount(owner, minlength=len(texts))
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    start, length, period = find_runs(codes, owner)
    edges = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    kept = np.cumsum(edges[:-1]) == 0
    rest = np.concatenate(([0], np.cumsum(np.bincount(owner[kept], minlength=len(texts)))))
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(rest, pa.int32()), flat.filter(pa.array(kept))), " ")
    of_doc = owner[start]
    ends = np.concatenate(([0], np.cumsum(np.bincount(of_doc, minlength=len(texts)))))
    first = (np.cumsum(counts) - counts)[of_doc]
    runs = pa.StructArray.from_arrays([pa.array(start - first), pa.array(length), pa.array(period)], fields=list(_RUN))
    return [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs), collapsed]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length and period, by start and period) and collapsed: the words outside the repeats, that
    is without those that a run holds after its first period, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _slices(batch.column("text")):
                columns = _worked(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), *columns], names=["doc_id", "n_words", "runs", "collapsed"])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RUNS_DDL)


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the contract's loops: where the crc32 h of the decimal doc_id ends in 0, words from a on repeat
    with period p, a = g mod n, p = 1 + floor((n - a) / (3 + g mod 8)), g = floor(h / 10). Rows without doc_id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    cut = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, words(F.col("text"))).alias("_w"))
    g, n = F.floor(F.col("_h") / 10).cast("long"), F.size("_w")
    step = cut.withColumn("_a", F.when(n > 0, g % n).cast("int")).withColumn(
        "_p", F.when(n > 0, 1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int"))

    def looped(word: Column, i: Column) -> Column:
        return F.when(i < F.col("_a"), word).otherwise(F.get("_w", F.col("_a") + (i - F.col("_a")) % F.col("_p")))

    return step.select("doc_id", F.when(n > 0, F.array_join(F.transform("_w", looped), " ")).otherwise(F.col("text")).alias("text"))


def greatest_run(runs: Column) -> Column:
    """The run of greatest length, ties to the smallest start, then period; null if there is none."""
    return F.get(F.array_sort(F.transform(runs, lambda r: F.struct(
        (-r["length"]).alias("down"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), 0)


def runs_text(runs: Column) -> Column:
    """``start,length,period`` and a line feed per run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
