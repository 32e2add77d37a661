"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks of bounded size and every pair of
blocks is a tile for one task. In a tile the vectors are rounded to int8 with a
scale each; the product of the rounded vectors, computed exactly, differs from
the true one by at most a known bound. Pairs whose upper bound reaches the k-th
best lower bound survive and are computed again from the original vectors in
double precision; a heap per query keeps its best. The tiles' bests are then
ranked per query.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.durable import cut

#: Vectors of a block, and candidates and queries of one product.
BLOCK, STEP, ROWS = 8192, 2048, 256


def _rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 values, as floats for the product, and scales: x is nearly values * scale."""
    scale = np.abs(x).max(axis=1, initial=0) / 127
    scale[scale == 0] = 1
    return np.rint(x / scale[:, None]).astype(np.int8).astype(np.float32), scale


def _bounds(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products of rows of q and x.

    With q = a + e and x = b + f, where a and b are the rounded vectors and
    every |e| <= s / 2, |f| <= t / 2: q.x - a.b = e.x + a.f, at most
    s / 2 * |x|_1 + t / 2 * |a|_1. A product of int8 vectors is a whole number
    below 2**24 for up to 1040 dimensions, so floats hold it exactly; past that
    it is taken in double precision.
    """
    (a, s), (b, t) = _rounded(q), _rounded(x)
    wide = np.float32 if q.shape[1] <= 1040 else np.float64
    middle = (a.astype(wide) @ b.astype(wide).T).astype(np.float64) * s[:, None] * t
    slack = s[:, None] / 2 * np.abs(x).sum(axis=1) + (np.abs(a).sum(axis=1) * s)[:, None] * t / 2
    slack = slack * (1 + 1e-9) + 1e-300
    return middle - slack, middle + slack


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("embedding").combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def tile(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k best (query, vector, product) per query of one tile."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    for i in range(0, len(q), ROWS):
        rows = slice(i, i + ROWS)
        for j in range(0, len(x), STEP):
            cols = slice(j, j + STEP)
            low, high = _bounds(q[rows], x[cols])
            own = q_ids[rows, None] == x_ids[cols]
            low[own], high[own] = -np.inf, -np.inf
            n = low.shape[1]
            floor = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(low), -np.inf)
            floor = np.maximum(floor, [h[0][0] if len(h) == k else -np.inf for h in heaps[rows]])
            a, b = np.nonzero((high >= floor[:, None]) & ~own)
            score = np.concatenate([np.zeros(0), *((q[i + a[m : m + 20_000]] * x[j + b[m : m + 20_000]]).sum(axis=1) for m in range(0, len(a), 20_000))])
            ids = x_ids[cols][b]
            order = np.lexsort((ids, -score, a))
            a, ids, score = a[order], ids[order], score[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            for r, v, s in zip(a[place < k].tolist(), ids[place < k].tolist(), score[place < k].tolist(), strict=True):
                heap = heaps[i + r]
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                elif (s, -v) > heap[0]:
                    heapq.heapreplace(heap, (s, -v))
    return [(int(query), -v, s) for query, heap in zip(q_ids.tolist(), heaps, strict=True) for s, v in heap]


def _tile(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = []
        if len(queries) and len(vectors):
            out = tile(queries.column("vec_id").to_numpy(), _matrix(queries), vectors.column("vec_id").to_numpy(), _matrix(vectors), k)
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "vec_id": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.float64())})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """One row for each vec_id whose vector is not null, empty or zero and has only finite components."""
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(sound & F.exists("embedding", lambda v: v != 0) & F.col("vec_id").isNotNull())
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nearest(vectors: DataFrame, is_query, k: int = 20, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``vectors (vec_id, embedding)`` where ``is_query``, its k nearest others by inner product.

    Ties go to the smaller vec_id. Vectors that ``usable`` leaves out take no
    part; of rows with one vec_id the least vector counts; vectors of different
    lengths are never compared. A query with fewer candidates gets them all.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = cut(usable(vectors).withColumn("dims", F.size("embedding")))
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    across, down = max(1, math.ceil(sizes["n"] / block)), max(1, math.ceil(sizes["q"] / block))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where(is_query).select("dims", deal(down, 1).alias("row"), "vec_id", "embedding").withColumn("col", every(across))
    others = rows.select("dims", deal(across, 2).alias("col"), "vec_id", "embedding").withColumn("row", every(down))
    tiles = queries.groupBy("dims", "row", "col").cogroup(others.groupBy("dims", "row", "col"))
    found = tiles.applyInArrow(_tile(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
