"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint of 64 bits is cut into a ring of three segments. If two fingerprints differ in at most 2 bits, then from some
segment of the ring on, every chain of l segments differs in at most 2l/3 bits: the first segment not at all, the first
two in at most one bit. So the first segment together with the second, or with one bit of it flipped, is an equality key of
43 bits. Only pairs that meet under such a key take the full Hamming test. Fingerprints are first made distinct: a group
of equal texts is one row from there on. Groups of linked fingerprints are found by passing down least labels and
jumping along them; every round is a table in the shared folder.

Defined cases: null and wordless texts have fingerprint zero and are linked like any other; a text of one or two words is
one shingle; null doc_ids are not taken as component_id unless a group has no other; repeated rows are returned each; an
empty table gives an empty table; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolake.session import remove, stable

SHINGLE, SEED, LEAST_BITS = 3, 42, 2
WIDTHS = (22, 21, 21)


def fingerprint(text: str | None) -> int:
    """The 64 bits as a signed number."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and the six ASCII blanks count
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    last = ends.tolist()[SHINGLE - 1:] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, last)), "<u8", len(last))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        some = hashes[at:at + (1 << 14)]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp (long, the fingerprint's bits) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(prints, pa.int64())], names=["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(
        run, "doc_id long, text_hash long, fp long")


def _chain_keys() -> list[Column]:
    """For each start in the ring: number of the start, first segment, second segment in the low bits."""
    low = [sum(WIDTHS[i + 1:]) for i in range(3)]
    segment = [F.shiftrightunsigned("fp", low[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1)) for i in range(3)]
    return [
        F.shiftleft(F.shiftleft(F.lit(i).cast("long"), 22).bitwiseOR(segment[i]), 22).bitwiseOR(segment[(i + 1) % 3])
        for i in range(3)]


def links(prints: DataFrame) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) that differ in at most 2 bits."""
    keys = _chain_keys()
    listed = prints.select(F.col("fp").alias("b"), F.explode(F.array(*keys)).alias("key"))
    tried = [keys[i].bitwiseXOR(F.lit(flip)) for i in range(3) for flip in (0, *(1 << j for j in range(WIDTHS[(i + 1) % 3])))]
    probes = prints.select(F.col("fp").alias("a"), F.explode(F.array(*tried)).alias("key"))
    met = probes.join(listed, "key").where("a < b and bit_count(a ^ b) <= 2")
    return met.select("a", "b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """node and root (the least node reachable) for every node of ``pairs`` (a, b)."""
    both = stable(pairs.union(pairs.select("b", "a")).toDF("u", "v"))
    last = stable(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).toDF("node", "root"))
    labels = last
    while True:
        heard = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("root").alias("near"))
        passed = labels.join(heard, labels.node == heard.u).select("node", "root", F.least("root", "near").alias("next"))
        ends = labels.select(F.col("node").alias("_at"), F.col("root").alias("_to"))
        jumped = stable(passed.join(ends, passed.next == ends["_at"], "left").select(
            "node", F.least("next", "_to").alias("root"), (F.least("next", "_to") < F.col("root")).alias("moved")))
        remove(last)
        last, labels = jumped, jumped.select("node", "root")
        if not jumped.where("moved").limit(1).count():
            remove(both)
            return labels


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text_hash, fp), and for every fingerprint the first row of its group: fp, none, doc_id, text_hash.

    First is the least doc_id, then the least text hash; rows without doc_id come last.
    """
    rows = stable(fingerprints(docs))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    prints = stable(rows.groupBy("fp").agg(F.min(order).alias("first")))
    roots = components(links(prints))
    placed = prints.join(roots, prints.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    return rows, placed.join(least, "root").select("fp", "least.*")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id reachable over links, for every row."""
    rows, groups = grouped(docs)
    of_print = groups.select("fp", F.col("doc_id").alias("component_id"))
    return rows.join(of_print, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, the first, with all its columns; of rows equal in doc_id and text, the one
    whose hash over all columns is least."""
    return keep_first(docs, grouped(docs)[1])


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``groups`` names by none, doc_id and text_hash, each once."""
    first = groups.select(
        F.coalesce("doc_id", F.lit(0)).alias("_d"), F.col("none").alias("_n"), F.col("text_hash").alias("_h")).distinct()
    keyed = docs.select(
        F.struct(*docs.columns).alias("_doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_d"),
        F.col("doc_id").isNull().alias("_n"), F.xxhash64(F.col("text").cast("string")).alias("_h"))
    kept = keyed.join(first, ["_d", "_n", "_h"], "left_semi")
    same = Window.partitionBy("_d", "_n", "_h").orderBy(F.xxhash64("_doc"))
    return kept.withColumn("_copy", F.row_number().over(same)).where("_copy = 1").select(
        *[F.col("_doc").getField(c).alias(c) for c in docs.columns])
