"""Quality classifier by Bradley-Terry pairwise ranking.

1. Every text is measured once, whole: shares and rates of its signs, words and lines (``FEATURES``). The narrow table of measures is
   staged; texts are not read again, and only measures are joined with labels.
2. A bounded sample of labelled rows of each class (``SAMPLE``, the first in hash order) forms preference pairs: every sampled
   row of the larger class with one or more of the other, all of both classes used. The chance that a good text is preferred to
   a bad one is the logistic function of the difference of their scores, so weights come from the logistic loss on feature
   differences (Newton steps, a small quadratic penalty, no intercept).
3. All rows labelled for training are scored, and the score quantile at the share of bad ones among them is found by counting
   in bins, twice, then taking the middle between its neighbours. The logistic function shifted there gives scores
   from 0 to 1 that are at least ``LEAST_SCORE`` exactly for the texts ranked above the quantile.

Defined cases: null and blank texts have measures of zero and are scored like any other; labels other than 0 and 1, labels
without doc_id and doc_ids labelled both ways teach nothing; a doc_id labelled repeatedly alike counts once per row of the
documents; without labels of both classes every score is 0.5; null doc_ids are held out; repeated rows are scored each; an
empty table gives an empty table; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.session import stable

FEATURES = (
    "symbols", "bars", "capitals", "shouts", "equal_neighbours", "distinct", "top_word", "equal_lines", "digits", "word_length",
    "stops", "other_letters", "log_words", "near_repeats",
)
#: Labelled rows of each class that the weights are learnt from, at most.
SAMPLE, PAIRS_EACH = 20_000, 2
PENALTY, STEPS, WIDEST = 1e-3, 30, 8.0
LEAST_SCORE = 0.3
BINS = 1 << 14
SIGNS = np.zeros(256, bool)
SIGNS[list(b"#*$%&<>@^~_=+\\")] = True
FEATURES_DDL = "doc_id long, features array<double>"


def measures(text: str | None) -> list[float]:
    """The features of a text; all lie between 0 and about 15."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    letters = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(letters[65:91].sum()), int(letters[97:123].sum())
    lines = [line for line in raw.split(b"\n") if line.strip()]
    counts = Counter(words)
    near = sum(map(eq, words, words[1:]))
    later = sum(map(eq, words, words[2:])) + sum(map(eq, words, words[3:]))
    return [
        min(4.0, int(letters[SIGNS].sum()) / n), counts[b"|"] / n, upper / max(1, upper + lower), min(4.0, int(letters[33]) / n), near / n,
        len(counts) / n, max(counts.values()) / n, 1 - len(set(lines)) / len(lines), int(letters[48:58].sum()) / len(raw),
        min(15.0, sum(map(len, words)) / n), min(4.0, int(letters[[44, 46, 58, 59]].sum()) / n), int(letters[128:].sum()) / len(raw),
        float(np.log1p(n)), later / n,
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and features per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measures(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FEATURES_DDL)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is kept for testing: crc32 of its decimal id, modulo the folds, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def labelled(measured: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``measured`` rows with a training label: doc_id, features, good (boolean)."""
    clear = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("least"), F.max(label).alias("most")).where("least = most")
    return measured.join(clear.select("doc_id", (F.col("least") == 1).alias("good")), "doc_id")


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` feature rows, the first by hash: the same on any cluster."""
    some = rows.select("features", F.xxhash64("doc_id", "features").alias("h")).orderBy("h", "features").limit(most).select("features")
    return np.asarray([row["features"] for row in some.collect()], np.float64).reshape(-1, len(FEATURES))


@dataclass(frozen=True)
class Ranker:
    """Standardized linear score: sum of weight * clip((x - mean) / spread)."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -WIDEST, WIDEST) @ self.weights

    def column(self, x: Column) -> Column:
        parts = [
            F.lit(float(w)) * F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), (F.get(x, i) - float(m)) / float(s)))
            for i, (m, s, w) in enumerate(zip(self.mean, self.spread, self.weights))]
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        return total


def preference_pairs(good: int, bad: int, each: int = PAIRS_EACH) -> np.ndarray:
    """(good row, bad row) numbers: each row of the larger class meets ``each`` of the other, dealt evenly."""
    many, few = max(good, bad), min(good, bad)
    first = np.repeat(np.arange(many), each)
    second = (first + np.tile(np.arange(each), many) * max(1, few // each)) % max(1, few)
    return np.stack((first, second) if good >= bad else (second, first), axis=1)


def fit(good: np.ndarray, bad: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> Ranker:
    """Weights that make good rows beat bad ones, by Newton's method on the logistic loss of score differences."""
    every = np.concatenate((good, bad))
    mean, spread = every.mean(axis=0), every.std(axis=0)
    plain = Ranker(mean, np.where(spread > 1e-12, spread, 1.0), np.zeros(every.shape[1]))
    x, y = (np.clip((part - plain.mean) / plain.spread, -WIDEST, WIDEST) for part in (good, bad))
    pairs = preference_pairs(len(good), len(bad))
    gaps = x[pairs[:, 0]] - y[pairs[:, 1]]
    weights = plain.weights
    for _ in range(steps):
        wins = 1 / (1 + np.exp(-np.clip(gaps @ weights, -500, 500)))
        slope = gaps.T @ (wins - 1) / len(gaps) + penalty * weights
        curve = (gaps * (wins * (1 - wins))[:, None]).T @ gaps / len(gaps) + penalty * np.eye(len(weights))
        move = np.linalg.solve(curve, slope)
        weights = weights - move
        if np.abs(move).max() < 1e-10:
            break
    return Ranker(plain.mean, plain.spread, weights)


def score_quantile(scores: DataFrame, share: float) -> float:
    """The middle between the last score within the lowest ``share`` of all rows and the next greater one.

    ``scores`` has a column s. Counts by bin find the bin, counts in ever finer bins the place; a list has at most ``BINS`` rows.
    """
    total, low, high = scores.agg(F.count("s"), F.min("s"), F.max("s")).first()
    wanted, before = max(1, min(total, round(share * total))), 0
    while low < high:
        width = max((high - low) / BINS, sys.float_info.min * sys.float_info.epsilon)
        bin_of = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("s") - low) / width)))
        inside = scores.where((F.col("s") >= low) & (F.col("s") <= high)).groupBy(bin_of.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
        for row in sorted(inside.collect(), key=lambda r: r["bin"]):
            if before + row["n"] >= wanted:
                low, high = row["low"], row["high"]
                break
            before += row["n"]
    above = scores.where(F.col("s") > high).agg(F.min("s")).first()[0]
    return high if above is None else (high + above) / 2


def rank_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, features, held_out, score (0 to 1) and predicted (1 where the score is at least ``LEAST_SCORE``) per row."""
    measured = stable(features(docs))
    known = stable(labelled(measured, labels, label))
    good, bad = (_sample(known.where(F.col("good") == side), sample) for side in (True, False))
    score = F.lit(0.5)
    if len(good) and len(bad):
        ranker = fit(good, bad)
        raw = ranker.column(F.col("features"))
        shares = known.agg(F.avg((~F.col("good")).cast("double")).alias("bad")).first()["bad"]
        cut = score_quantile(known.select(raw.alias("s")), shares)
        # At the cut the logistic function is LEAST_SCORE.
        shift = cut + float(np.log((1 - LEAST_SCORE) / LEAST_SCORE))
        score = F.when(raw >= cut, F.greatest(F.lit(LEAST_SCORE), 1 / (1 + F.exp(shift - raw)))).otherwise(
            F.least(F.lit(float(np.nextafter(LEAST_SCORE, 0))), 1 / (1 + F.exp(shift - raw))))
    return measured.select("doc_id", "features", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= LEAST_SCORE).cast("int"))
