"""Large JSON documents read by many tasks: the elements of their top-level lists, one row each.

A label document is often one JSON object on one line, with lists of millions of objects. Spark's JSON reader gives such a file to
one task. Here the text reader cuts it at closing braces, in byte ranges like any text file; pieces that follow each other are put
together to chunks of about a megabyte, and the structure is found again with running totals:

1. An escape never spans a closing brace (``\\}`` is no escape), so each chunk tells its unescaped quotes by itself. Their running
   count says whether a chunk begins inside a string.
2. Brackets outside strings give the depth before each chunk. A chunk is summed for both cases, begun outside and inside a
   string, and for every depth, so that one pass over the text is enough; what is carried over chunks is a small table.
3. Where depth returns to 2 an element ends. The list it stands in is the last one opened at depth 2.

The signs of a chunk are found as arrays, not sign by sign. Only the table of chunks, without their text, is put in order; every
chunk then gives its elements by itself, and only elements that span chunks are put together.

Defined cases: braces, brackets and quotes in strings and escaped quotes are text; blank lists give no rows; lists of numbers, texts or
lists are passed over; a byte order mark and white space anywhere are allowed; several files may be read at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annolake.session import remove, stable

#: Bytes of a chunk, unless a single piece has more.
CHUNK = 1 << 20
_QUOTE = 2
_SIGNS = np.zeros(256, np.int8)
_SIGNS[list(b"{[")], _SIGNS[list(b"}]")], _SIGNS[ord('"')] = 1, -1, _QUOTE
_KEPT = ("closes", "opened")
_CHUNKS = (
    "file string, block long, seq long, piece string, quotes long, depth array<int>, "
    "closes array<map<int,long>>, opened array<map<int,string>>")
_ELEMENTS = "file string, list string, place long, block long, seq long, part int, text string"
#: Parts of an element: all of it, or its first, a further or its last one.
WHOLE, FIRST, FURTHER, LAST = range(4)


def _signs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of unescaped quotes and brackets, what they are, and the number of quotes up to each."""
    sign = _SIGNS[data]
    at = np.flatnonzero(sign)
    sign = sign[at]
    slashes = np.flatnonzero(data == ord("\\"))
    if len(slashes):
        begins = np.diff(slashes, prepend=-2) > 1
        run = np.maximum.accumulate(np.where(begins, slashes, 0))
        escaped = np.zeros(len(data) + 1, bool)
        escaped[slashes[(slashes - run) % 2 == 0] + 1] = True
        at, sign = at[~escaped[at]], sign[~escaped[at]]
    return at, sign, np.cumsum(sign == _QUOTE)


def _name(data: np.ndarray, at: np.ndarray, sign: np.ndarray, place: int) -> str:
    """The key in front of the bracket at ``place``; blank for a brace or without a key. A key never spans pieces, as far as it has no brace."""
    quotes = at[:np.searchsorted(at, place)][-2:]
    if data[place] != ord("[") or len(quotes) < 2 or (sign[np.searchsorted(at, quotes)] != _QUOTE).any():
        return ""
    if not re.fullmatch(rb"\s*:\s*", data[quotes[1] + 1:place].tobytes()):
        return ""
    return re.sub(rb"\\.", b"", data[quotes[0] + 1:quotes[1]].tobytes()).decode("utf-8", "replace")


def _summary(data: np.ndarray) -> tuple[int, list, list, list]:
    """Quotes and, for a chunk begun outside and inside a string: the change of depth, by depth the objects that end there, and by depth the
    last list opened there."""
    at, sign, quotes = _signs(data)
    depths, closes, opened = [], [], []
    for inside in (0, 1):
        place = at[(sign != _QUOTE) & (quotes % 2 == inside)]
        change = _SIGNS[data[place]]
        depth = np.cumsum(change, dtype=np.int64)
        depths.append(int(depth[-1]) if len(depth) else 0)
        ends, n = np.unique(depth[data[place] == ord("}")], return_counts=True)
        closes.append(list(zip(ends.tolist(), n.tolist())))
        up = np.flatnonzero(change == 1)[::-1]
        levels, last = np.unique(depth[up], return_index=True)
        opened.append([(int(d), _name(data, at, sign, int(place[up[i]]))) for d, i in zip(levels, last)])
    return int(quotes[-1]) if len(quotes) else 0, depths, closes, opened


def _pieces(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Every file in chunks, in order by block and seq, each one piece of text with its summary."""
    most = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            pieces, blocks = batch.column("piece"), batch.column("block").to_numpy()
            files = batch.column("file").dictionary_encode()
            new = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(files.indices.to_numpy()) != 0)) + 1
            kind = np.int64 if pa.types.is_large_string(pieces.type) else np.int32
            ends = np.frombuffer(pieces.buffers()[1], kind)[pieces.offset:pieces.offset + len(pieces) + 1]
            data = np.frombuffer(pieces.buffers()[2], np.uint8)
            for first, last in zip([0, *new.tolist()], [*new.tolist(), len(pieces)]):
                while first < last:
                    # As many pieces as fit, at least one.
                    after = min(last, max(first + 1, int(np.searchsorted(ends, int(ends[first]) + most, "right")) - 1))
                    text = data[ends[first]:ends[after]]
                    quotes, depth, closes, opened = _summary(text)
                    yield pa.RecordBatch.from_arrays([
                        batch.column("file").slice(first, 1), batch.column("block").slice(first, 1), pa.array([seq]),
                        pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, len(text)], np.int32)), pa.py_buffer(text)]), pa.array([quotes], pa.int64()), pa.array([depth], pa.list_(pa.int32())), pa.array([closes], pa.list_(pa.map_(pa.int32(), pa.int64()))),
                        pa.array([opened], pa.list_(pa.map_(pa.int32(), pa.string())))], names=["file", "block", "seq", "piece", "quotes", "depth", *_KEPT])
                    first, seq = after, seq + 1

    text = spark.read.option("lineSep", "}").text(paths if isinstance(paths, str) else list(paths))
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.concat("value", F.lit("}")).alias("piece"),
    ).mapInArrow(run, _CHUNKS)


def _taken(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts from ``begins`` to ``ends``, which follow each other without overlap."""
    edges = np.zeros(len(data) + 1, np.int8)
    edges[begins] += 1
    edges[ends] -= 1
    offsets = np.concatenate(([0], np.cumsum(ends - begins)))
    kept = data[np.cumsum(edges[:-1], dtype=np.int8).view(bool)]
    return pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(kept)]).cast(pa.string())


def _elements(chunks: DataFrame, lists: Sequence[str]) -> DataFrame:
    """The elements in ``lists`` of chunks that are told how they begin: inside a string or not (flip), at which depth (level), behind
    how many elements (closed) and in which list (open)."""
    wanted = set(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = np.frombuffer(batch.column("piece")[row].as_buffer(), np.uint8)
                file, block, seq, flip, level, closed, now = (batch.column(c)[row].as_py() for c in ("file", "block", "seq", "flip", "level", "closed", "open"))
                at, sign, quotes = _signs(data)
                place = at[(sign != _QUOTE) & ((quotes + flip) % 2 == 0)]
                what = data[place]
                depth = level + np.cumsum(_SIGNS[what], dtype=np.int64)
                opens = place[(_SIGNS[what] == 1) & (depth == 2)]
                names = [now or "", *[_name(data, at, sign, int(o)) for o in opens]]
                begins, ends = place[(what == ord("{")) & (depth == 3)], place[(what == ord("}")) & (depth == 2)] + 1
                whole, inner = np.arange(len(ends)) + closed, ends
                parts = []
                if len(ends) and (not len(begins) or ends[0] <= begins[0]):
                    parts.append((LAST, 0, int(ends[0]), closed, names[0]))
                    whole, inner = whole[1:], ends[1:]
                elif not len(ends) and not len(begins) and level >= 3:
                    parts.append((FURTHER, 0, len(data), closed, names[0]))
                listed = np.searchsorted(opens, begins)
                if len(begins) > len(inner):
                    parts.append((FIRST, int(begins[-1]), len(data), closed + len(ends), names[listed[-1]]))
                    begins, listed = begins[:-1], listed[:-1]
                asked = np.array([name in wanted for name in names])[listed]
                parts = [part for part in parts if part[4] in wanted]
                places, which = whole[asked], [names[i] for i in listed[asked]]
                texts = pa.chunked_array([_taken(data, begins[asked], inner[asked]), pa.array([data[a:b].tobytes().decode(errors="replace") for _, a, b, _, _ in parts], pa.string())])
                n = len(texts)
                yield pa.RecordBatch.from_arrays([
                    pa.array([file] * n, pa.string()), pa.array([*which, *[p[4] for p in parts]], pa.string()),
                    pa.array([*places.tolist(), *[p[3] for p in parts]], pa.int64()), pa.array([block] * n, pa.int64()), pa.array([seq] * n, pa.int64()),
                    pa.array([*[WHOLE] * len(places), *[p[0] for p in parts]], pa.int32()), texts.combine_chunks()],
                    names=["file", "list", "place", "block", "seq", "part", "text"])

    return chunks.select("file", "block", "seq", "flip", "level", "closed", "open", "piece").mapInArrow(run, _ELEMENTS)


def list_elements(spark: SparkSession, paths: str | Sequence[str], lists: Sequence[str]) -> DataFrame:
    """file, list, place (from 0 over the whole file) and text of every object in the named top-level lists."""
    # Staged once: the chunks below must be those that were summed.
    chunks = stable(_pieces(spark, paths))
    before = Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, -1)

    def zero(column: Column) -> Column:
        return F.coalesce(column, F.lit(0))

    # The index of what a chunk holds for the way it begins, and the depth from its start at which elements end.
    own, ends_at = F.col("flip"), (2 - F.col("level")).cast("int")
    entered = chunks.drop("piece").withColumn("flip", (zero(F.sum("quotes").over(before)) % 2).cast("int"))
    entered = entered.withColumn("level", zero(F.sum(F.get("depth", own)).over(before)))
    entered = entered.withColumn("closed", zero(F.sum(F.get("closes", own)[ends_at]).over(before))).withColumn(
        "open", F.last(F.get("opened", own)[ends_at], ignorenulls=True).over(before))
    # One row per chunk, of a few numbers and a name: sent to the chunks, as dealing them would move all text.
    entered = stable(entered.select("file", "block", "seq", "flip", "level", "closed", "open"))
    found = stable(_elements(chunks.select("file", "block", "seq", "piece").join(F.broadcast(entered), ["file", "block", "seq"]), lists))
    remove(chunks)
    parts = F.array_sort(F.collect_list(F.struct("block", "seq", "part", "text")))
    spanning = found.where(F.col("part") != WHOLE).groupBy("file", "list", "place").agg(parts.alias("parts"))
    # What stands before the first part belongs to lists of lists.
    first = F.array_position(F.transform("parts", lambda p: p["part"]), FIRST).cast("int")
    spanning = spanning.where((first > 0) & (F.element_at("parts", -1)["part"] == LAST)).select(
        "file", "list", "place", F.array_join(F.transform(F.slice("parts", first, F.size("parts")), lambda p: p["text"]), "").alias("text"))
    return found.where(F.col("part") == WHOLE).select("file", "list", "place", "text").union(stable(spanning))
