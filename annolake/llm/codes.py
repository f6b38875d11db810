"""Token files of directly addressable codes.

An id is cut into 8-bit chunks, low chunk first. Level k holds the k-th chunks of all ids that have one, a bitmap that says
which of these ids go on to level k + 1, and a rank directory: the number of set bits before every 512th bit. Token i is
read without decoding a block: take chunk i, and while its bit is set go to chunk rank(i) of the next level.

A file is a Parquet table with one row per segment, so it can lie in any store Spark reads. Segments hold whole documents,
about ``SEGMENT_TOKENS`` ids, in ascending doc_id order over parts and seq.

Defined cases: null text is empty, so the document is its end id only; null doc_ids come first; rows that repeat a doc_id
follow each other in text order; an empty table gives no segment; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.llm.tokens import encoded
from annolake.session import scratch_path, shuffle_partitions

CHUNK_BITS, RANK_STEP = 8, 512
SEGMENT_TOKENS = 1 << 20
SEGMENT = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
    ("chunks", pa.list_(pa.binary())), ("bitmaps", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())),
])
SEGMENT_DDL = (
    "part int, seq int, part_start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, "
    "chunks array<binary>, bitmaps array<binary>, ranks array<binary>")


def to_levels(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, bitmaps and rank directories, level by level."""
    rest, chunks, bitmaps, ranks = ids.astype(np.uint32), [], [], []
    while True:
        more = rest >> CHUNK_BITS > 0
        chunks.append((rest & 0xFF).astype(np.uint8).tobytes())
        bitmaps.append(np.packbits(more, bitorder="little").tobytes())
        counts = np.add.reduceat(more, np.arange(0, len(more), RANK_STEP), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks.append((np.cumsum(counts, dtype=np.uint32) - counts).astype("<u4").tobytes())
        rest = rest[more] >> CHUNK_BITS
        if not len(rest):
            return chunks, bitmaps, ranks


def from_levels(chunks: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    levels = [np.frombuffer(c, np.uint8).astype(np.uint32) for c in chunks]
    for level in range(len(levels) - 2, -1, -1):
        more = np.unpackbits(np.frombuffer(bitmaps[level], np.uint8), count=len(levels[level]), bitorder="little").astype(bool)
        levels[level][more] |= levels[level + 1] << CHUNK_BITS
    return levels[0]


def token_at(chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes], i: int) -> int:
    """The i-th id of a segment by direct addressing."""
    value = 0
    for level in range(len(chunks)):
        value |= chunks[level][i] << (CHUNK_BITS * level)
        if not bitmaps[level][i >> 3] >> (i & 7) & 1:
            break
        block = i // RANK_STEP
        head = np.frombuffer(bitmaps[level], np.uint8, count=(i >> 3) + 1 - block * RANK_STEP // 8, offset=block * RANK_STEP // 8)
        bits = np.unpackbits(head, bitorder="little")[:i - block * RANK_STEP]
        i = int(np.frombuffer(ranks[level], "<u4", count=1, offset=4 * block)[0]) + int(bits.sum())
    return value


def write_codes(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None, segment_tokens: int = SEGMENT_TOKENS) -> str:
    """Encode, append the end id, write in doc_id order; returns the folder, a fresh shared one where none is given."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "codes")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start, size, ids, held = TaskContext.get().partitionId(), 0, 0, 0, [], []
        end = np.asarray([end_id], "<u4").tobytes()

        def flush() -> pa.RecordBatch:
            levels = to_levels(np.frombuffer(b"".join(held), "<u4"))
            row = [part, seq, start, size, list(ids), [len(h) // 4 for h in held], *levels]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, SEGMENT)], schema=SEGMENT)

        for doc_id, tokens in encoded(batches, vocabulary, leading=True):
            ids.append(doc_id)
            held.append(tokens + end)
            size += len(tokens) // 4 + 1
            if size >= segment_tokens:
                yield flush()
                seq, start, size, ids, held = seq + 1, start + size, 0, [], []
        if ids:
            yield flush()

    # The head of the text splits rows without doc_id and those that repeat one; it agrees with the order of whole texts.
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(
        shuffle_partitions(docs), "doc_id", F.substring("text", 1, 48)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(segments, SEGMENT_DDL).write.parquet(path)
    return path


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit), first_id and last_id per
    document; the last two are read by direct addressing and must agree with the ids."""
    table = spark.read.schema(SEGMENT_DDL).parquet(path)
    sizes = {row["part"]: row["n"] for row in table.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, at = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append(at)
        at += sizes.get(part, 0)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = from_levels(row["chunks"], row["bitmaps"]).astype("<u4")
                ends = np.cumsum(row["doc_tokens"])
                starts = ends - np.asarray(row["doc_tokens"])
                base = before[row["part"]] + row["part_start"]
                edges = [[token_at(row["chunks"], row["bitmaps"], row["ranks"], int(i)) for i in at] for at in (starts, ends - 1)]
                if any(ids[at].tolist() != found for at, found in zip((starts, ends - 1), edges)):
                    raise ValueError("a segment's rank directories do not agree with its bitmaps")
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(starts + base, pa.int64()), pa.array(row["doc_tokens"], pa.int64()),
                    pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()), *[pa.array(e, pa.int64()) for e in edges],
                ], names=["doc_id", "start", "n_tokens", "ids", "first_id", "last_id"])

    return table.select("part", "part_start", "doc_ids", "doc_tokens", "chunks", "bitmaps", "ranks").mapInArrow(
        documents, "doc_id long, start long, n_tokens long, ids binary, first_id long, last_id long")
