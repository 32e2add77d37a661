"""Joins of crowded keys against plain ones."""

import random

from graphloom.llm.crowds import crowded, meet


def test_crowded_keys_join_as_others(spark):
    rng = random.Random(8)
    rows = [(7, i) for i in range(400)] + [(rng.randrange(20), rng.randrange(50)) for _ in range(100)] + [(7, 3), (None, 1), (99, 1)]
    table = [(k, f"t{k}") for k in range(25)] + [(7, "again"), (None, "none")]
    left, right = spark.createDataFrame(rows, "key long, x long"), spark.createDataFrame(table, "key long, text string")
    crowds = crowded(left, "key", most=16)
    assert {r["key"]: r["blocks"] for r in crowds.collect()}[7] >= 400 / 16
    got = meet(left, right, "key", "x", crowds)
    assert got.columns == ["key", "x", "text"]
    assert sorted(map(tuple, got.collect())) == sorted((k, x, t) for k, x in rows for key, t in table if k is not None and k == key)
    assert meet(left.limit(0), right, "key", "x", crowded(left.limit(0), "key")).isEmpty()
