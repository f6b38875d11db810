"""Perceptual hashes and the exact Hamming join."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.session import spread, stable

HASH_BITS = 64
HOT_BUCKET = 2_000
#: Blocks beyond the threshold: keys of this many blocks, at every size.
SPARE_BLOCKS = 2


def gray_cells(pixels: DataFrame, sizes: DataFrame, side: int = 32) -> DataFrame:
    """Grey values on an evenly spaced grid, one row per grid cell in row order.

    ``pixels``: image_id, y, x, b, g, r; ``sizes``: image_id, width, height.
    """
    spots = lambda extent: F.transform(
        F.sequence(F.lit(0), F.lit(side - 1)), lambda i: F.bround(i * (extent - 1) / float(side - 1)).cast("int")
    )
    planned = sizes.select("image_id", spots(F.col("width")).alias("_xs"), spots(F.col("height")).alias("_ys"))
    hits = lambda places, value: F.filter(
        F.sequence(F.lit(0), F.lit(side - 1)), lambda i: F.get(places, i) == value
    )
    gray = (F.col("b") * 0.114 + F.col("g") * 0.587 + F.col("r") * 0.299).cast("float")
    wanted = pixels.join(planned, "image_id").where(
        F.array_contains("_xs", F.col("x")) & F.array_contains("_ys", F.col("y"))
    )
    cells = (
        wanted.select("image_id", gray.alias("v"), F.explode(hits(F.col("_ys"), F.col("y"))).alias("oy"),
                      hits(F.col("_xs"), F.col("x")).alias("_ox"))
        .select("image_id", "v", "oy", F.explode("_ox").alias("ox"))
    )
    return cells.select("image_id", (F.col("oy") * side + F.col("ox")).alias("i"), "v")


def gray_grid(pixels: DataFrame, sizes: DataFrame, side: int = 32) -> DataFrame:
    """The grid cells of each image as one array of side*side values."""
    cells = gray_cells(pixels, sizes, side)
    ordered = F.array_sort(F.collect_list(F.struct("i", "v")))
    return cells.groupBy("image_id").agg(F.transform(ordered, lambda e: e["v"].cast("double")).alias("gray"))


def perceptual_hash(gray: Column, side: int = 32) -> Column:
    """64-bit DCT hash of a side*side grey array as a signed long.

    Bits are the top-left 8x8 coefficients above the median of the 63 after the first,
    row by row, most significant first. One Arrow batch is one matrix product.
    """
    u, i = np.arange(8)[:, None], np.arange(side)[None, :]
    basis = np.sqrt(np.where(u == 0, 1.0, 2.0) / side) * np.cos(np.pi * (2 * i + 1) * u / (2 * side))

    @F.pandas_udf("long")
    def hashed(values: pd.Series) -> pd.Series:
        known = values.notna()
        result = pd.Series(pd.NA, index=values.index, dtype="Int64")
        if known.any():
            grids = np.stack(values[known].to_numpy()).astype(np.float64).reshape(-1, side, side)
            low = (basis @ grids @ basis.T).reshape(-1, 64)
            bits = low > np.median(low[:, 1:], axis=1, keepdims=True)
            result[known] = np.packbits(bits, axis=1).view(">i8").ravel().astype(np.int64)
        return result

    return hashed(gray)


def resolve_hash(df: DataFrame, precomputed: DataFrame, cache: DataFrame) -> DataFrame:
    """Hash by priority: given per sample, cached by path, cached by sample, else to compute."""
    given = precomputed.groupBy("sample_id").agg(F.max("phash").alias("_given"))
    by_path = cache.groupBy("image_path").agg(F.max("phash").alias("_path"))
    by_sample = cache.groupBy("sample_id").agg(F.max("phash").alias("_sample"))
    cached = F.coalesce("_path", "_sample")
    return (
        df.join(given, "sample_id", "left").join(by_path, "image_path", "left").join(by_sample, "sample_id", "left")
        .withColumn("phash", F.coalesce(F.col("_given"), cached))
        .withColumn(
            "hash_source",
            F.when(F.col("_given").isNotNull(), "precomputed").when(cached.isNotNull(), "local_cache").otherwise("computed"),
        )
        .select(*df.columns, "phash", "hash_source")
    )


def near_hash_pairs(hashes: DataFrame, threshold: int, blocks: int | None = None, hot: int = HOT_BUCKET) -> DataFrame:
    """Unordered pairs of distinct 64-bit values within ``threshold`` bits, each exactly once.

    The bits are cut into more blocks than may differ. Values this close agree on at least
    ``blocks - threshold`` blocks, so each choice of that many blocks is an equi-join key. A
    pair found under several choices is kept only under the first, decided from its XOR, so
    no pass over the pairs removes repeats. Buckets above ``hot`` values are keyed once more
    by the blocks left over, which splits clusters of alike values. The pairs are staged.
    """
    if not 0 <= threshold < HASH_BITS:
        raise ValueError("threshold must be between 0 and 63")
    values = stable(hashes.select("phash").where(F.col("phash").isNotNull()).distinct())
    if threshold == 0:
        empty = values.limit(0)
        return empty.select(
            F.col("phash").alias("a"), F.col("phash").alias("b"), F.lit(0).cast("int").alias("distance")
        )
    blocks = blocks or threshold + SPARE_BLOCKS
    if not threshold < blocks <= HASH_BITS:
        raise ValueError("blocks must exceed the threshold")
    cuts = [round(i * HASH_BITS / blocks) for i in range(blocks + 1)]
    spans = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(blocks)]
    signed = lambda mask: mask - (1 << 64) if mask >= 1 << 63 else mask
    sets = list(combinations(range(blocks), blocks - threshold))
    masks = [signed(sum(spans[i] for i in chosen)) for chosen in sets]

    keyed = values.select(
        "phash",
        F.posexplode(F.array(*[F.col("phash").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("choice", "key"),
    )
    # Keys are dealt and sorted once; a task then goes through its buckets one after the other.
    sorted_keys = spread(keyed, "choice", "key").sortWithinPartitions("key", "choice")
    met = stable(sorted_keys.mapInArrow(_bucket_pairs(masks, threshold, hot), "a long, b long, distance int"))
    pairs = met.where("distance >= 0")
    crowded = met.where("distance < 0").select(F.col("a").alias("phash"), F.col("b").cast("int").alias("choice"))
    if crowded.isEmpty():
        return pairs
    # Inside a crowded bucket the chosen blocks agree, so the differing bits lie in the other
    # ``threshold`` blocks; cutting their bits into one part more gives another agreeing key.
    rest = [[i for i in range(blocks) if i not in chosen] for chosen in sets]
    fine = [_even_masks([spans[i] for i in others], threshold + 1) for others in rest]
    fine_masks = F.array(*[F.array(*[F.lit(signed(m)).cast("long") for m in parts]) for parts in fine])
    cells = crowded.select("phash", "choice", F.posexplode(F.get(fine_masks, F.col("choice"))).alias("part", "_mask")).select(
        "phash", "choice", F.col("phash").bitwiseAND(F.get(F.array(*[F.lit(m).cast("long") for m in masks]), F.col("choice"))).alias("key"),
        "part", F.col("phash").bitwiseAND(F.col("_mask")).alias("bits"))
    left, right = cells.withColumnRenamed("phash", "a"), cells.withColumnRenamed("phash", "b")
    # Buckets fan out into many candidates, so even a small table is spread over shuffle tasks.
    close = left.hint("merge").join(right, ["choice", "key", "part", "bits"]).where(F.col("a") < F.col("b"))
    xor = F.col("a").bitwiseXOR(F.col("b"))
    agrees = lambda mask: xor.bitwiseAND(F.lit(mask).cast("long")) == 0
    first_choice = F.coalesce(*[F.when(agrees(m), i) for i, m in enumerate(masks)])
    earlier = F.exists(F.slice(F.get(fine_masks, F.col("choice")), F.lit(1), F.col("part")), lambda m: xor.bitwiseAND(m) == 0)
    close = close.where(F.bit_count(xor) <= threshold).where((F.col("choice") == first_choice) & ~earlier)
    return stable(pairs.unionByName(close.select("a", "b", F.bit_count(xor).alias("distance"))))


def _bucket_pairs(masks: list[int], threshold: int, hot: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows phash, choice, key, those of a bucket in a row, to the close pairs a < b whose first choice this is.

    Values of a bucket above ``hot`` come out as rows (value, choice, -1). At most a batch and ``hot`` rows are held.
    """
    # Pairs that are put together at once.
    most = 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.asarray(masks, np.int64)

        def out(a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(distance.astype(np.int32), pa.int32())], names=["a", "b", "distance"])

        def many(value: np.ndarray, choice: np.ndarray) -> pa.RecordBatch:
            return out(value, choice.astype(np.int64), np.full(len(value), -1))

        def close(value: np.ndarray, choice: np.ndarray, left: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Pairs of every row with the ``left`` rows of its bucket that follow it."""
            ends = np.cumsum(left)
            begin = 0
            while begin < len(value):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
                times = left[begin:end]
                one = np.repeat(np.arange(begin, end), times)
                two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(times) - times, times)
                xor = value[one] ^ value[two]
                distance = np.bitwise_count(xor.view(np.uint64))
                near = np.flatnonzero(distance <= threshold)
                near = near[np.argmax((xor[near, None] & bits) == 0, axis=1) == choice[one[near]]]
                if len(near):
                    a, b = value[one[near]], value[two[near]]
                    yield out(np.minimum(a, b), np.maximum(a, b), distance[near])
                begin = end

        held = None  # rows of the last bucket, which the next batch may go on with
        crowd = None  # a bucket known to be crowded
        for batch in batches:
            value, choice, key = (batch.column(name).to_numpy() for name in ("phash", "choice", "key"))
            if not len(value):
                continue
            if crowd is not None:
                same = (choice == crowd[0]) & (key == crowd[1])
                n = len(same) if same.all() else int(np.argmin(same))
                if n:
                    yield many(value[:n], choice[:n])
                    value, choice, key = value[n:], choice[n:], key[n:]
                if not len(value):
                    continue
                crowd = None
            if held is not None:
                value, choice, key = (np.concatenate(both) for both in zip(held, (value, choice, key)))
            starts = np.concatenate(([0], np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1))
            sizes = np.diff(np.append(starts, len(value)))
            for start, size in zip(starts[sizes > hot].tolist(), sizes[sizes > hot].tolist()):
                yield many(value[start:start + size], choice[start:start + size])
            # The last bucket waits for the next batch, unless it is crowded already.
            last = int(starts[-1])
            held, crowd = (None, (choice[last], key[last])) if sizes[-1] > hot else ((value[last:], choice[last:], key[last:]), None)
            left = np.repeat(starts + sizes, sizes) - np.arange(len(value)) - 1
            left[np.repeat(sizes > hot, sizes)] = 0
            yield from close(value[:last], choice[:last], left[:last])
        if held is not None:
            yield from close(held[0], held[1], np.arange(len(held[0]))[::-1])

    return run


def _even_masks(spans: list[int], parts: int) -> list[int]:
    """Split the set bits of the spans into exactly ``parts`` masks of about equal size."""
    bits = [i for i in range(HASH_BITS) if any(span >> i & 1 for span in spans)]
    cuts = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << i for i in bits[cuts[p] : cuts[p + 1]]) for p in range(parts)]


def near_duplicates(
    df: DataFrame, threshold: int = 4, cross_key: str = "split", order: str = "sample_id",
    carry: tuple[str, ...] = ("split", "group_id", "image_path"), blocks: int | None = None,
    hot: int = HOT_BUCKET,
) -> DataFrame:
    """Record pairs within ``threshold`` bits whose ``cross_key`` differs; left is the earlier.

    Distances are worked out on distinct hashes, then paired with the splits that hold them.
    Records join only on those, so every joined row is a result row: copies of one image
    inside one split cost nothing.
    """
    rows = df.where(F.col("phash").isNotNull())
    near = near_hash_pairs(rows, threshold, blocks, hot)
    places = rows.select("phash", cross_key).distinct()
    place = lambda key, name: places.select(F.col("phash").alias(key), F.col(cross_key).alias(name))
    close = near.join(place("a", "sa"), "a").join(place("b", "sb"), "b").where(F.col("sa") != F.col("sb"))
    equal = place("a", "sa").join(place("b", "sb"), (F.col("a") == F.col("b")) & (F.col("sa") < F.col("sb")))
    columns = ["a", "sa", "b", "sb"]
    wanted = close.select(*columns, "distance").union(equal.select(*columns, F.lit(0)))
    keep = list(dict.fromkeys([order, cross_key, *carry]))
    record = F.struct(*keep)
    first = rows.select(F.col("phash").alias("a"), F.col(cross_key).alias("sa"), record.alias("_l"))
    second = rows.select(F.col("phash").alias("b"), F.col(cross_key).alias("sb"), record.alias("_r"))
    joined = wanted.join(first, ["a", "sa"]).join(second, ["b", "sb"])
    swap = F.col(f"_l.{order}") > F.col(f"_r.{order}")
    left = F.when(swap, F.col("_r")).otherwise(F.col("_l"))
    right = F.when(swap, F.col("_l")).otherwise(F.col("_r"))
    return joined.select(left.alias("_l"), right.alias("_r"), "distance").select(
        *[F.col(f"_l.{c}").alias(f"left_{c}") for c in keep],
        *[F.col(f"_r.{c}").alias(f"right_{c}") for c in keep],
        F.col("distance").alias("hamming_distance"),
    )


def duplicate_summary(df: DataFrame, threshold: int = 4, cross_key: str = "split") -> DataFrame:
    """Counts of cross-split pairs, from per-hash split counts: no record pair is built.

    Pairs over two hashes = n(a) n(b) less those of equal split; within one hash likewise.
    """
    rows = df.where(F.col("phash").isNotNull())
    counts = stable(rows.groupBy("phash", cross_key).agg(F.count(F.lit(1)).alias("n")))
    near = near_hash_pairs(rows, threshold)
    total = counts.groupBy("phash").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    exact = total.agg(F.coalesce(F.sum(((F.col("n") * F.col("n") - F.col("sq")) / 2).cast("long")), F.lit(0)))
    side = lambda key, name: total.select(F.col("phash").alias(key), F.col("n").alias(name))
    across = (
        near.join(side("a", "na"), "a").join(side("b", "nb"), "b")
        .agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)))
    )
    mine = counts.select(F.col("phash").alias("a"), F.col(cross_key).alias("s"), F.col("n").alias("na"))
    theirs = counts.select(F.col("phash").alias("b"), F.col(cross_key).alias("s"), F.col("n").alias("nb"))
    within = (
        near.join(mine, "a").join(theirs, ["b", "s"])
        .agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)))
    )
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("images_hashed")).select(
        "images_hashed",
        (across.scalar() - within.scalar() + exact.scalar()).alias("cross_split_candidates"),
        exact.scalar().alias("exact_hash_candidates"),
    )
