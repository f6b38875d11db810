"""Centroid clustering (k-means) with exact whole-number results and geometrically tightened bounds.

Every vector carries its cluster, and a lower bound on its distance to any other centroid. When the centroids move, the bound
of a vector in cluster i loses not the full drift of centroid j but at most what a point of i's sphere can lose. Take the plane
through the sphere's centre c (the old centroid i, radius: the largest distance in the cluster), the old place a of j and the
new place b. For a point x, |xa| - |xb| = (|xa|^2 - |xb|^2) / (|xa| + |xb|): the numerator is 2 |ab| times how far x lies beyond
the middle of ab, along ab, so at most 2 |ab| (t + r) with t that of c; the denominator is at least |ab| and at least
|ca| + |cb| - 2r. A centroid that moves away from the sphere, or sideways far off, so loosens the bound little or not at all.
A vector whose exact distance to its moved centroid is below its bound, or below half the way to the nearest other centroid,
keeps its cluster; all others are ambiguous and measured against every centroid in whole numbers, ties to the smaller number.

Each round reads the staged vectors once, where they lie, and writes them with their new state; nothing is shuffled but
partial sums of the vectors that moved: at most one row per cluster and task. Centroids, sphere radii and totals (k rows) go
through the driver. The table of a round is removed when the next one is written.

Defined cases: rows whose vector is null, has another number of components than asked for, or a null or non-finite component
take no part (256 times a component counts); rows without id are clustered but come last among the first centroids; repeated rows count each, and ids that tie
as first centroids are ordered by vector; with fewer vectors than clusters there are fewer clusters; an empty table
gives an empty table; other columns are ignored. Components beyond 2^27 are worked on as Python integers, beyond 2^58 they raise ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.session import literal_table, remove, stable

SCALE, NARROW, WIDEST = 256, 1 << 27, 1 << 58
#: Relative slack of bounds, far above the rounding of doubles.
SLACK = 1e-9
STATE_DDL = "vec_id long, v array<double>, cluster int, before int, distance decimal(38,0), lower double"
_STATE = pa.schema([
    ("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("cluster", pa.int32()), ("before", pa.int32()),
    ("distance", pa.decimal128(38, 0)), ("lower", pa.float64())])


def whole_vectors(vectors: DataFrame, dims: int, id_column: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components floor(scale * x) as doubles (exact), of the rows that take part."""
    numbers = F.transform(column, lambda x: x.cast("double"))
    fit = (F.size(column) == dims) & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    # Spark's floor gives a long; doubles beyond 2^53 are whole numbers as they are.
    scaled = F.transform(numbers, lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return vectors.where(F.col(column).isNotNull() & fit).select(F.col(id_column).cast("long").alias("vec_id"), scaled.alias("v"))


def first_centroids(vectors: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The vectors with the smallest sha256 of ``seed``:vec_id, in that order, as Python integers."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(clusters).collect()
    out = np.empty((len(rows), len(rows[0]["v"]) if rows else 0), object)
    for i, row in enumerate(rows):
        out[i] = [int(x) for x in row["v"]]
    return out


def _kind(vectors: np.ndarray, centroids: np.ndarray) -> type:
    """The number type in which all squared distances are exact."""
    top = max(float(np.abs(vectors).max(initial=0)), float(max(map(abs, centroids.ravel().tolist()), default=0)))
    if top >= WIDEST:
        raise ValueError("a component is too large to be clustered in whole numbers")
    if 4 * top * top * vectors.shape[1] < 1 << 52:
        return np.float64
    return np.int64 if top < NARROW and 4 * top * top * vectors.shape[1] < 1 << 62 else object


def _as(values: np.ndarray, kind: type) -> np.ndarray:
    if kind is not object:
        return values.astype(kind)
    return np.frompyfunc(int, 1, 1)(values)


def scan(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector the nearest centroid (ties: smaller number), the exact squared distance, and a bound below the distance to all others."""
    kind = _kind(vectors, centroids)
    x, c = _as(vectors, kind), _as(centroids, kind)
    squares = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    nearest = np.argmin(squares, axis=1)
    rows = np.arange(len(x))
    best = squares[rows, nearest]
    others = squares.astype(np.float64)
    others[rows, nearest] = np.inf
    return nearest, best, np.sqrt(others.min(axis=1, initial=np.inf)) * (1 - SLACK)


def own_distance(vectors: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Exact squared distance of each vector to the centroid of its cluster."""
    kind = _kind(vectors, centroids)
    apart = _as(vectors, kind) - _as(centroids, kind)[cluster]
    return (apart * apart).sum(axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """By cluster i: how much the distance from a point of its sphere to any other centroid can have shrunk by the move."""
    old, new = old.astype(np.float64), new.astype(np.float64)
    out = np.zeros(len(old))
    drift = np.linalg.norm(new - old, axis=1)
    for i, (centre, radius) in enumerate(zip(old, radii)):
        along = ((centre - (old + new) / 2) * (new - old)).sum(axis=1) / np.where(drift > 0, drift, 1)
        focal = np.linalg.norm(centre - old, axis=1) + np.linalg.norm(centre - new, axis=1) - 2 * radius
        loss = 2 * drift * np.maximum(0, along + radius) / np.maximum(np.maximum(drift, focal), 1e-300)
        loss = np.minimum(loss, drift)
        loss[i] = 0
        out[i] = loss.max(initial=0) * (1 + SLACK)
    return out


def half_gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the nearest other one; a vector nearer than that belongs to it alone."""
    c = centroids.astype(np.float64)
    apart = np.sqrt(np.maximum(0, ((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)))
    np.fill_diagonal(apart, np.inf)
    return apart.min(axis=1, initial=np.inf) / 2 * (1 - SLACK)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _state(batch: pa.RecordBatch, cluster: np.ndarray, before: np.ndarray | None, distance: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()),
        pa.nulls(len(cluster), pa.int32()) if before is None else pa.array(before, pa.int32()),
        pa.array([int(d) for d in distance], pa.decimal128(38, 0)), pa.array(lower, pa.float64())], schema=_STATE)


def _assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The first assignment: every vector against every centroid."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nearest, distance, lower = scan(_matrix(batch.column("v"), dims), centroids)
                yield _state(batch, nearest, None, distance, lower)

    return vectors.mapInArrow(run, STATE_DDL)


def _reassign(state: DataFrame, centroids: np.ndarray, loss: np.ndarray) -> DataFrame:
    """The assignment after a move: bounds first, the ambiguous vectors in full."""
    dims, gaps = centroids.shape[1], half_gaps(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, before = _matrix(batch.column("v"), dims), batch.column("cluster").to_numpy()
            lower = batch.column("lower").to_numpy() - loss[before]
            cluster, distance = before.copy(), own_distance(vectors, centroids, before)
            near = np.sqrt(distance.astype(np.float64)) * (1 + SLACK)
            unsure = np.flatnonzero(near >= np.maximum(lower, gaps[before]))
            if len(unsure):
                nearest, best, bound = scan(vectors[unsure], centroids)
                cluster[unsure], lower[unsure] = nearest, bound
                distance[unsure] = best
            yield _state(batch, cluster, before, distance, lower)

    return state.mapInArrow(run, STATE_DDL)


def _gains(state: DataFrame, dims: int) -> list[tuple[int, int, list[int]]]:
    """By cluster: change of the number of vectors and of their sum, from the vectors that moved."""
    moved = state.where("before is null or cluster <> before").select("v", F.explode(F.filter(F.array(
        F.struct(F.col("cluster").alias("k"), F.lit(1).alias("sign")), F.struct(F.col("before").alias("k"), F.lit(-1).alias("sign")),
    ), lambda s: s["k"].isNotNull())).alias("s"))

    def total(i: int) -> Column:
        return F.sum((F.col("s.sign") * F.col("v")[i]).cast("decimal(28,0)")).alias(f"s{i}")

    rows = moved.groupBy("s.k").agg(F.sum("s.sign").alias("n"), *[total(i) for i in range(dims)]).collect()
    return [(row["k"], row["n"], [int(x) for x in row[2:]]) for row in rows]


def cluster(vectors: DataFrame, clusters: int, dims: int, rounds: int, seed: str) -> tuple[DataFrame, np.ndarray]:
    """vec_id, v, cluster and distance (squared) of each of ``vectors`` (vec_id, v), and the final centroids.

    A round assigns all vectors, then moves every non-empty centroid to the floor of the mean; a last assignment follows.
    """
    given = stable(vectors)
    centroids = first_centroids(given, clusters, seed)
    if not len(centroids):
        return given.selectExpr("vec_id", "v", "cast(null as int) as cluster", "cast(null as decimal(38,0)) as distance"), centroids
    sums = np.zeros((len(centroids), dims), object)
    counts = np.zeros(len(centroids), object)
    state, loss = given, None
    for done in range(rounds + 1):
        last, state = state, stable(_assign(state, centroids) if loss is None else _reassign(state, centroids, loss))
        remove(last)
        if done == rounds:
            break
        for k, n, gain in _gains(state, dims):
            counts[k] += n
            sums[k] += np.asarray(gain, object)
        radii = np.zeros(len(centroids))
        for row in state.groupBy("cluster").agg(F.max("distance").alias("far")).collect():
            radii[row["cluster"]] = float(row["far"]) ** 0.5 * (1 + SLACK)
        moved = centroids.copy()
        for k in np.flatnonzero(counts > 0):
            moved[k] = sums[k] // counts[k]
        loss, centroids = loosening(centroids, moved, radii), moved
    return state, centroids


def with_totals(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256; the joined table has a row per cluster."""
    by_cluster = {row["cluster"]: int(row["total"]) for row in state.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    rows = [
        (k, by_cluster.get(k, 0), sum(by_cluster.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for k, c in enumerate(centroids)]
    totals = literal_table(state.sparkSession, rows, pa.schema([
        ("cluster", pa.int32()), ("cluster_inertia", pa.int64()), ("inertia", pa.int64()), ("centroid_sha256", pa.string())]))
    return state.join(totals, "cluster")
