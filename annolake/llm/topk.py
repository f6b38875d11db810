"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Rows are dealt by a hash into data shards, queries into blocks; every shard meets every block of the stated query set in one
task. In a shard each dimension has its list of rows sorted by value. For a query the lists are read from the end that its
component favours, ever deeper; rows seen are scored in full; no row unseen can score above the sum of the components times
the values at the present depth, so reading stops when the kth score is above that bound. The k best of all shards are
ranked per query.

Defined cases: null vectors and vectors with null or non-finite components take no part; a missing component counts as 0;
so do rows without vec_id;
ties go to the smaller vec_id; a query's own row is any row with its vec_id; repeated rows are candidates each, a repeated
query (same id, same vector) is answered once, queries that share only an id are ranked as one; an empty table gives an empty table; columns other than the id and the vector are
ignored. Products are exact: doubles while every sum is below 2^53, else Python integers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annolake.session import stable

K, SHARD_ROWS, BLOCK_QUERIES, FIRST_DEPTH = 5, 8192, 1024, 8


def quantized(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and v, the components floor(scale * x), of the rows that take part."""
    numbers = F.transform(column, lambda x: x.cast("double"))
    fit = F.col(id_column).isNotNull() & F.col(column).isNotNull() & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(fit).select(
        F.col(id_column).cast("long").alias("vec_id"), F.transform(numbers, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    rows = [np.asarray(v, dtype=np.int64) for v in column]
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def threshold_search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int = K) -> list[tuple]:
    """(query number, vec_id, score) of each query's k best rows other than its own."""
    top = max((int(abs(m).max()) if m.size else 0 for m in (rows, queries)), default=0)
    exact = np.float64 if top * top * max(1, rows.shape[1]) < 1 << 53 else object
    values, wanted = rows.astype(exact), queries.astype(exact)
    order = np.argsort(rows, axis=0, kind="stable").T  # a list of row numbers per dimension, ascending
    ordered = np.take_along_axis(rows.T, order, axis=1).astype(exact)
    n, found = len(rows), []
    for number, (query_id, q) in enumerate(zip(query_ids, wanted)):
        used = np.flatnonzero(q != 0)
        falling = q[used] > 0
        seen = np.zeros(n, bool)
        seen[ids == query_id] = True
        best_rows, best = np.zeros(0, np.int64), np.zeros(0, exact)
        depth, next_depth = 0, FIRST_DEPTH
        while depth < n:
            until = min(n, next_depth)
            if len(used):
                fresh = np.where(
                    falling[:, None], order[used, n - until:n - depth][:, ::-1], order[used, depth:until]).ravel()
            else:
                fresh = np.arange(n)
            mark = np.zeros(n, bool)
            mark[fresh] = True
            fresh = np.flatnonzero(mark & ~seen)
            seen |= mark
            depth, next_depth = until, next_depth * 2
            best_rows = np.concatenate((best_rows, fresh))
            best = np.concatenate((best, values[fresh] @ q))
            keep = np.lexsort((ids[best_rows], -best))[:k] if exact is np.float64 else np.asarray(
                sorted(range(len(best)), key=lambda i: (-best[i], ids[best_rows[i]]))[:k], dtype=np.int64)
            best_rows, best = best_rows[keep], best[keep]
            if depth >= n or not len(used):
                break
            bound = np.dot(q[used], np.where(falling, ordered[used, n - 1 - depth], ordered[used, depth]))
            if len(best) == k and best[-1] > bound:
                break
        found += [(number, int(ids[r]), int(s)) for r, s in zip(best_rows, best)]
    return found


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score, from quantized ``vectors`` and ``queries`` (vec_id, v)."""
    data, asked = stable(vectors), stable(queries.distinct())
    shards = max(1, math.ceil(data.count() / shard_rows))
    blocks = max(1, math.ceil(asked.count() / block_queries))
    own = F.xxhash64("vec_id", "v")
    left = data.select("vec_id", "v", F.pmod(own, F.lit(shards)).cast("int").alias("shard")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.select("vec_id", "v", F.pmod(own, F.lit(blocks)).cast("int").alias("block")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        width = max((len(v) for part in (rows, wanted) for v in part["v"]), default=0)
        ids, query_ids = rows["vec_id"].to_numpy(np.int64), wanted["vec_id"].to_numpy(np.int64)
        hits = threshold_search(ids, _matrix(rows["v"], width), query_ids, _matrix(wanted["v"], width), k) if len(rows) else []
        return pd.DataFrame([(int(query_ids[q]), v, s) for q, v, s in hits], columns=["query_id", "vec_id", "score"])

    best = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(
        search, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
