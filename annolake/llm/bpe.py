"""Byte-level BPE by ranks: merges folded over distinct words with Spark's higher-order functions.

1. Texts are split by the pattern; each task counts its distinct words, and the counts are summed.
2. The most frequent words, at most ``most_words`` of at most ``WORD_BYTES`` bytes each, are encoded once by a fold over their
   byte arrays with a literal rank map, and broadcast as flat arrays: the bound holds at every size of the corpus.
3. Texts are replaced by ids; words beyond the bound are left as gaps and folded where they stand, then filled in.

In Python the texts of about a megabyte are one column: words, ids and pieces are taken by Arrow, with no Python object for each.

The fold works on text with one character (0 to 255) per byte. Words of any length are folded; the fold costs
the square of the length, with small factors.

Defined cases: null text is empty and has no ids; repeated rows are encoded each; null doc_ids are kept; an empty table
gives an empty table; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import functools
import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.functions.geometry import let
from annolake.session import shuffle_partitions, stable

MOST_WORDS, WORD_BYTES = 1 << 20, 48
BUCKETS = 1 << 14
NONE = 2_147_483_647
GAP = 0xFFFFFFFF
TASK_WORDS, SLICE_BYTES = 1 << 19, 1 << 20
#: The pattern whose words are found by classes of characters; any other goes to the regex library.
CLASS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, SPACE = 1, 2, 3


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def _bucket(piece: str) -> int:
    return xxhash.xxh64_intdigest(piece.encode(), 42) % BUCKETS


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The rank map as one literal, array<map<string,int>>: dealt into buckets by hash, as Spark scans the keys of a map."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for key, rank in ranks.items():
        text = key.decode("latin-1")
        buckets[_bucket(text)][text] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def rank_of(piece: Column, table: Column) -> Column:
    """Rank of a piece, null where it has none."""
    # xxhash64 is signed; BUCKETS is a power of two, so the low bits agree with the unsigned value.
    return F.try_element_at(F.get(table, F.xxhash64(piece).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), piece)


def fold_merges(word: Column, table: Column) -> Column:
    """ids of a word given as one character per byte; ``table`` is a rank map.

    State: the parts, the rank of every adjacent pair, the least of them and its first place. Each step joins that pair and
    looks up the two pairs it touches; without any pair left a step changes nothing.
    """

    def rank(piece: Column) -> Column:
        return F.coalesce(rank_of(piece, table), F.lit(NONE))

    size = F.char_length(word)
    none = F.array().cast("array<int>")
    single = F.transform(F.sequence(F.lit(1), size), lambda i: F.substr(word, i, F.lit(1)))
    pairs = F.when(size > 1, F.transform(
        F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: rank(F.substr(word, i, F.lit(2))))).otherwise(none)

    def state(parts: Column, adjacent: Column) -> Column:
        return F.struct(parts.alias("parts"), adjacent.alias("pairs"))

    def joined(s: Column, at: Column) -> Column:
        both = F.concat(F.get(s["parts"], at - 1), F.get(s["parts"], at))
        before = F.when(at > 1, F.array(rank(F.concat(F.get(s["parts"], at - 2), both)))).otherwise(none)
        after = F.when(at < F.size(s["pairs"]), F.array(rank(F.concat(both, F.get(s["parts"], at + 1))))).otherwise(none)
        return state(
            F.concat(F.slice(s["parts"], F.lit(1), at - 1), F.array(both), F.slice(s["parts"], at + 2, F.size(s["parts"]))),
            F.concat(
                F.slice(s["pairs"], F.lit(1), F.greatest(at - 2, F.lit(0))), before, after,
                F.slice(s["pairs"], at + 2, F.size(s["pairs"]))))

    def step(s: Column, _: Column) -> Column:
        least = F.array_min(s["pairs"])
        at = F.array_position(s["pairs"], least).cast("int")
        return F.when(F.coalesce(least, F.lit(NONE)) == NONE, s).otherwise(let(at, lambda place: joined(s, place)))

    merged = F.aggregate(
        F.sequence(F.lit(1), size), state(single, pairs), step, lambda s: F.transform(s["parts"], lambda p: rank_of(p, table)))
    whole = rank_of(word, table)
    return F.when(size == 0, none).when(whole.isNotNull(), F.array(whole)).otherwise(merged)


def fold_bytes(word: Column, table: Column) -> Column:
    """ids of a binary word. Its text is bound, as the fold names it often."""
    return let(F.decode(word, "ISO-8859-1"), lambda text: fold_merges(text, table))


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``SLICE_BYTES`` of a column, or one row above that."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, before = 0, 0
        while at < len(ends):
            until = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES - size, "right")))
            held.append(batch.slice(at, until - at))
            size += int(ends[until - 1]) - before
            at, before = until, int(ends[until - 1])
            if size >= SLICE_BYTES or at < len(ends):
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the values of a text or binary column without nulls, from 0, and their bytes."""
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    ends = np.frombuffer(ends, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return ends - ends[0], data


def _binary(ends: np.ndarray, data: pa.Buffer | np.ndarray) -> pa.Array:
    """A binary column of the values that end there."""
    if ends[-1] > np.iinfo(np.int32).max:
        raise OverflowError("more than 2 GB in one batch")
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point: letter, number, space, or 0 for the rest."""
    every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    found = np.zeros(0x110000, np.uint8)
    for kind, runs in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(runs, every):
            found[run.start():run.end()] = kind
    return found


def _starts(chars: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Where a match of ``CLASS_PATTERN`` starts; ``opens`` marks the first characters of texts."""
    kind, start = _classes()[chars], opens.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # The last of some spaces is cut off before other characters, and a blank goes to them.
    start[:-1] |= space[:-1] & ~space[1:] & ~opens[1:]
    start[1:] &= opens[1:] | space[1:] | (chars[:-1] != ord(" "))
    # An apostrophe that starts a match takes s, t, m, d, re, ve or ll along.
    mark = np.flatnonzero(start[:-1] & (chars[:-1] == ord("'")) & ~opens[1:])
    for tail in ("s", "t", "m", "d", "re", "ve", "ll"):
        at = mark[mark + len(tail) < len(chars)]
        for step, char in enumerate(tail, 1):
            at = at[(chars[at + step] == ord(char)) & ~opens[at + step]]
        start[at + 1] = False
        after = at + 1 + len(tail)
        start[after[after < len(chars)]] = True
    return start


def splitter(pattern: str) -> Callable[[pa.Array], tuple[pa.Array, np.ndarray]]:
    """The function that gives the words (binary) of a text column, and where those of each text end among them, from 0."""

    def by_class(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        ends, data = _flat(pc.fill_null(texts, ""))
        if not len(data):
            return pa.array([], pa.binary()), np.zeros(len(ends), np.int64)
        first = np.zeros(len(data), bool)
        first[ends[:-1][ends[:-1] < ends[1:]]] = True
        if data.max() < 128:
            at = np.flatnonzero(_starts(data, first))
        else:
            lead, cut = (data & 0xC0) != 0x80, np.zeros(len(data), bool)
            cut[lead] = _starts(np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4"), first[lead])
            at = np.flatnonzero(cut)
        return _binary(np.append(at, len(data)), data), np.append(np.searchsorted(at, ends[:-1]), len(at))

    def by_regex(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        find = regex.compile(pattern).findall
        cut = [find(text or "") for text in texts.to_pylist()]
        words = pa.array([word.encode() for word in itertools.chain.from_iterable(cut)], pa.binary())
        return words, np.cumsum([0, *map(len, cut)])

    return by_class if pattern == CLASS_PATTERN else by_regex


def word_counts(docs: DataFrame, pattern: str) -> DataFrame:
    """word (binary) and n over all texts; words above ``WORD_BYTES`` bytes are left out."""

    def summed(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        counts = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")])
        yield from counts.select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches(50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, parts, held = splitter(pattern), [], 0
        for batch in _slices(batches, "text"):
            words, n = split(batch.column("text"))[0].value_counts().flatten()
            fit = pc.less_equal(pc.binary_length(words), WORD_BYTES)
            parts.append(pa.table({"word": words.filter(fit), "n": n.filter(fit)}))
            held += len(parts[-1])
            if held > TASK_WORDS:
                yield from summed(parts)
                parts, held = [], 0
        if parts:
            yield from summed(parts)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """The words above the least count that leaves at most ``most_words`` of them."""
    level = F.when(F.col("n") <= 1000, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long"))
    sizes = sorted((row["level"], row["words"]) for row in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect())
    least, kept = None, 0
    for at, words in reversed(sizes):
        if kept + words > most_words:
            break
        least, kept = at, kept + words
    return counts.where(F.lit(False) if least is None else F.col("n") >= least).select("word")


def _ranked(words: pa.Array) -> np.ndarray:
    """The ids of all words, one after the other."""
    ids = words.flatten()
    if ids.null_count:
        raise KeyError("a byte without a rank")
    return ids.to_numpy(zero_copy_only=False).astype(np.uint32)


class WordTable:
    """Words and their ids, found by hash and then compared; the last row stands for all other words and has ``GAP`` as id."""

    def __init__(self, table: pa.Table) -> None:
        table = table.take(pa.array(np.argsort(table.column("hash").to_numpy(), kind="stable"))).combine_chunks()
        self.hashes = table.column("hash").to_numpy()
        words, ids = (pa.concat_arrays(table.column(name).chunks or [pa.array([], kind)]) for name, kind in (
            ("word", pa.binary()), ("ids", pa.list_(pa.int32()))))
        self.words = pa.concat_arrays([words, pa.array([b""])])
        ends = np.append(0, np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False), dtype=np.int64))
        flat = np.append(_ranked(ids), np.uint32(GAP))
        self.ids = pa.ListArray.from_arrays(pa.array(np.append(ends, len(flat)), pa.int32()), pa.array(flat))

    def find(self, words: pa.Array) -> np.ndarray:
        """The row of each word, or the last one."""
        rows = len(self.hashes)
        hashes = np.fromiter((xxhash.xxh64_intdigest(word, 42) for word in words.to_pylist()), np.uint64, len(words)).view(np.int64)
        at = np.searchsorted(self.hashes, hashes)
        # Where two words share a hash, the second is folded where it stands.
        same = pc.equal(self.words.take(pa.array(at)), words).to_numpy(zero_copy_only=False)
        return np.where(same & (at < rows), at, rows)


def _filled(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch with its gaps filled in, and where those of each row end, from 0."""
    ends, data = _flat(batch.column("ids"))
    ends, flat = ends // 4, data.view("<u4")
    gap = flat == GAP
    if gap.any():
        words = batch.column("rare").flatten()
        sizes = np.ones(len(flat), np.int64)
        sizes[gap] = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        flat = np.repeat(flat, sizes)
        flat[np.repeat(gap, sizes)] = _ranked(words)
        ends = np.append(0, np.cumsum(sizes))[ends]
    return flat, ends


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most_words: int = MOST_WORDS, decoded: bool = False) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) per row; ``decoded`` adds the bytes of the ids in the same pass."""
    counts = stable(word_counts(docs, pattern))
    chosen = frequent_words(counts, most_words).repartition(shuffle_partitions(docs), "word")
    table = rank_map(ranks)
    # The map is bound once per expression: plans print literals in full wherever they stand.
    known = chosen.select("word", F.xxhash64("word").alias("hash"), let(table, lambda t: fold_bytes(F.col("word"), t)).alias("ids"))
    held = docs.sparkSession.sparkContext.broadcast(WordTable(known.toArrow()))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, table = splitter(pattern), held.value
        for batch in _slices(batches, "text"):
            words, ends = split(batch.column("text"))
            coded = words.dictionary_encode()
            rows, codes = table.find(coded.dictionary), coded.indices.to_numpy()
            ids = table.ids.take(pa.array(rows)).take(coded.indices)
            id_ends = np.append(0, np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False), dtype=np.int64))
            rare = (rows == len(table.hashes))[codes]
            rare_ends = np.append(0, np.cumsum(rare))[ends]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), _binary(id_ends[ends] * 4, ids.flatten().to_numpy(zero_copy_only=False)),
                pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), words.filter(pa.array(rare))),
            ], names=["doc_id", "ids", "rare"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "ids"):
            flat, ends = _filled(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _binary(ends * 4, flat)], names=["doc_id", "ids"])

    pieces = _pieces(ranks)

    def fill_and_decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(fill(batches), pieces)

    gapped = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        look_up, "doc_id long, ids binary, rare array<binary>")
    folded = gapped.select("doc_id", "ids", F.when(F.size("rare") > 0, let(table, lambda t: F.transform(
        "rare", lambda word: fold_bytes(word, t)))).otherwise(F.array().cast("array<array<int>>")).alias("rare"))
    if decoded:
        return folded.mapInArrow(fill_and_decode, DECODED_DDL)
    return folded.mapInArrow(fill, "doc_id long, ids binary")


DECODED_DDL = "doc_id long, ids binary, decoded binary"


def _pieces(ranks: dict[bytes, int]) -> pa.Array:
    """The piece of every rank, null between them."""
    pieces: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pa.array(pieces, pa.binary())


def _decoded(batches: Iterator[pa.RecordBatch], pieces: pa.Array) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, "ids"):
        ends, data = _flat(batch.column("ids"))
        found = pieces.take(pa.array(data.view("<u4")))
        if found.null_count:
            raise KeyError("an id without a piece")
        piece_ends, text = _flat(found)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("ids"), _binary(piece_ends[ends // 4], text)], names=["doc_id", "ids", "decoded"])


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` (doc_id, ids) plus decoded (binary): the pieces of the ids, one after the other."""
    pieces = _pieces(ranks)
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decoded(batches, pieces), DECODED_DDL)
