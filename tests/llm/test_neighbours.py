"""Block matrix join against brute force."""

import numpy as np
from graphloom.llm import neighbours
from pyspark.sql import functions as F


def brute(vectors: dict[int, list[float]], k: int) -> list[tuple]:
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], np.float32).astype(np.float64)
    out = []
    for i, q in zip(ids, x, strict=True):
        if i % 20 == 0:
            score = (x * q).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out += [(int(i), n + 1, int(ids[j]), float(score[j])) for n, j in enumerate(order)]
    return sorted(out)


def found(spark, rows, k=5, block=64):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    return sorted(tuple(r) for r in neighbours.nearest(table, F.col("vec_id") % 20 == 0, k, block).collect())


def test_equals_brute_force_with_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=16).astype(np.float32).tolist() for i in range(400)}
    vectors |= {i: vectors[7] for i in range(100, 220)}  # a large group of copies
    vectors |= {i: [0.5] * 16 for i in range(300, 330)}
    rows = [(i, v, "x") for i, v in vectors.items()]
    assert found(spark, rows + rows[:50]) == brute(vectors, 5)


def test_unusable_vectors_take_no_part(spark):
    good = {20 * i: [float(i + 1), 1.0] for i in range(4)}
    bad = [(1, None, ""), (2, [0.0, 0.0], ""), (3, [None, 1.0], ""), (4, [float("nan"), 1.0], ""), (5, [float("inf"), 1.0], ""), (None, [1.0, 1.0], ""), (6, [], "")]
    assert found(spark, [(i, v, "") for i, v in good.items()] + bad) == brute(good, 5)
    assert found(spark, []) == []
    assert found(spark, bad) == []


def test_bounds_hold():
    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(40, 64)), rng.normal(size=(50, 64)) * rng.lognormal(size=(50, 1))
    low, high = neighbours._bounds(q, x)
    assert (low <= q @ x.T).all() and (q @ x.T <= high).all()
