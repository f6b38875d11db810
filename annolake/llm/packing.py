"""Lexical retrieval packing: related documents share a training window.

Documents are taken as they lie in the partitions and gathered into shards of about ``SHARD_TOKENS`` ids; each shard has a
BM25 index of its own, whose terms are token ids. A document's full windows are sequences by themselves; what is left of
it is an item of the shard. A seed item, the next unused one, opens a window; its most telling terms are looked up and the
unused neighbours, best score first, fill the window, asked for again until none is left, then by its further terms; the last
one is cut where the window ends, and its rest stays an unused item. With no neighbour left, the next unused item follows. So only the last window of a shard is not full.

A task holds one shard at a time. Defined cases: null text is empty, so the document is its end id only; repeated rows and
null doc_ids are packed as they come; a text longer than a window is cut; an empty table gives no piece; columns other than
doc_id and text are ignored. Which documents meet depends on how the input is partitioned; a task run again gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.llm.tokens import encoded

WINDOW = 2048
SHARD_TOKENS = 3 << 20
QUERY_TERMS, NEIGHBOURS = 12, 12
K1, B = 1.2, 0.75
PIECE_DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Bm25:
    """Postings by term over the items of one shard, with their BM25 weights."""

    def __init__(self, items: list[np.ndarray]) -> None:
        n = len(items)
        lengths = np.fromiter(map(len, items), np.int64, n)
        pairs = np.concatenate(items).astype(np.int64) * n + np.repeat(np.arange(n), lengths)
        pairs, tf = np.unique(pairs, return_counts=True)
        terms, self._items = np.divmod(pairs, n)
        self._terms, self._first, df = np.unique(terms, return_index=True, return_counts=True)
        self._end = self._first + df
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean()))
        self._weights = (np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self._items])).astype(np.float32)
        # The terms of each item, the most telling ones first, that any other item has too.
        shared = np.repeat(df > 1, df)
        rows, slots = self._items[shared], np.repeat(np.arange(len(df)), df)[shared]
        order = np.lexsort((slots, -self._weights[shared], rows))
        self._slots, self._at = slots[order], np.searchsorted(rows[order], np.arange(n + 1))
        self._n = n

    def n_terms(self, item: int) -> int:
        return int(self._at[item + 1] - self._at[item])

    def neighbours(self, item: int, used: np.ndarray, after: int = 0) -> list[int]:
        """Unused items by falling score over the item's next terms ``after`` so many, ties to the earlier one."""
        scores = np.zeros(self._n, np.float32)
        for slot in self._slots[self._at[item]:self._at[item + 1]][after:after + QUERY_TERMS]:
            a, b = self._first[slot], self._end[slot]
            scores[self._items[a:b]] += self._weights[a:b]
        scores[used] = 0
        top = np.argpartition(-scores, NEIGHBOURS)[:NEIGHBOURS] if self._n > NEIGHBOURS else np.arange(self._n)
        top = top[scores[top] > 0]
        return top[np.lexsort((top, -scores[top]))].tolist()


def pack_shard(documents: list[tuple], window: int = WINDOW) -> Iterator[tuple]:
    """(document, start, length, sequence, offset) of each piece; documents are (doc_id, ids)."""
    items, owner, start, sequence = [], [], [], 0
    for d, (_, ids) in enumerate(documents):
        full = len(ids) // window * window
        for at in range(0, full, window):
            yield d, at, window, sequence, 0
            sequence += 1
        if full < len(ids):
            items.append(ids[full:])
            owner.append(d)
            start.append(full)
    if not items:
        return
    index, used, left = Bm25(items), np.zeros(len(items), bool), [len(item) for item in items]
    for seed in range(len(items)):
        while not used[seed]:
            room, queue, spare = window, [seed], seed
            asked, terms = 0, index.n_terms(seed)
            while room:
                while not queue and asked < terms:
                    queue = index.neighbours(seed, used, asked)
                    asked += 0 if queue else QUERY_TERMS
                if queue:
                    item = queue.pop(0)
                else:
                    while spare < len(items) and used[spare]:
                        spare += 1
                    if spare == len(items):
                        break
                    item = spare
                size = min(room, left[item])
                yield owner[item], start[item], size, sequence, window - room
                start[item] += size
                left[item] -= size
                room -= size
                used[item] = not left[item]
            sequence += 1


def pack(docs: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (binary, little-endian unsigned 32-bit).

    sequence_id is unique: 2^36 times the partition, plus the number of the sequence in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, end = TaskContext.get().partitionId() << 36, np.asarray([end_id], "<u4").tobytes()
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        kinds = [pa.int64()] * 6 + [pa.binary()]

        def pieces(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal first
            rows, last = [], -1
            for d, start, length, sequence, offset in pack_shard(held, window):
                doc_id, ids = held[d]
                rows.append((doc_id, start, length, len(ids), first + sequence, offset, ids[start:start + length].tobytes()))
                last = max(last, sequence)
            first += last + 1
            for at in range(0, len(rows), 2000):
                columns = zip(*rows[at:at + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        held, size = [], 0
        for doc_id, tokens in encoded(batches, vocabulary, leading=False):
            held.append((doc_id, np.frombuffer(tokens + end, "<u4")))
            size += len(held[-1][1])
            if size >= shard_tokens:
                yield from pieces(held)
                held, size = [], 0
        yield from pieces(held)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE_DDL)
