"""Order MinHash against the same choice made point by point in plain Python."""

import hashlib
import random
import re
import struct

import duckdb
import xxhash
from graphloom.llm import fingerprints, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def xx(*values, seed: int = 42) -> int:
    """Spark's xxhash64 of strings and longs, null ones left out."""
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<q", v) if not isinstance(v, tuple) else struct.pack("<i", v[0])
            seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def plain(text, k=3, points=64, turns=1, most=2) -> list[int]:
    words = re.findall(fingerprints.WORDS_APART, text or "")
    if not words:
        return [0] * points * turns
    hashes = [xx(w) for w in words] + [None] * (k - 1)
    seen, grams, out = {}, [], []
    for at in range(max(1, len(words) - k + 1)):
        h = xx(*hashes[at : at + k])
        c = seen[h] = seen.get(h, -1) + 1
        grams.append((xx(h, (c,)) if c else h, at))
    for turn in range(turns):
        own = [(xx(h, (turn,)) if turn else h, at) for h, at in grams]
        for point in range(points):
            begin = (point - points // 2) * (1 << 64) // points
            near = sorted(own, key=lambda x, b=begin: ((x[0] - b) % (1 << 64), x[1]))[:most]
            picked = sorted((near[i % len(near)] for i in range(most)), key=lambda x: (x[1], x[0]))
            out.append(xx(*[h for h, _ in picked]) >> 32)
    return out


def hexed(numbers: list[int]) -> str:
    return "".join(f"{x & 0xFFFFFFFF:08x}" for x in numbers)


def texts() -> list:
    rng = random.Random(5)
    some = [" ".join(rng.choices(["a", "b", "cc", "d\n", "日本語", "x" * 60, "é"], k=rng.randrange(1, 60))) for _ in range(60)]
    return [None, "", " \n ", "one", "one two", "one two three", "a a a a a a a a", *some, " ".join(map(str, range(30_000))), "y" * 100_000]


def test_numbers_as_chosen_point_by_point(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "i int, t string")
    for kind in ({}, {"k": 2, "points": 8, "turns": 3, "most": 1}, {"points": 16, "most": 4}):
        got = dict(df.select("i", fingerprints.order_minhash(F.col("t"), **kind)).collect())
        for i, t in enumerate(texts()):
            assert got[i] == plain(t, **kind), (kind, t and t[:80])


def test_likeness_falls_with_edits_and_moves(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    few = [w if rng.random() > 0.01 else "new" for w in words]
    many = [w if rng.random() > 0.2 else "new" for w in words]
    turned = words[1000:] + words[:1000]
    rows = [(" ".join(words), " ".join(x)) for x in (words, few, many, turned, [f"v{i}" for i in range(2000)])]
    f = lambda c: fingerprints.order_minhash(F.col(c))
    same, a, b, moved, none = (r[0] for r in spark.createDataFrame(rows, "a string, b string").select(fingerprints.likeness(f("a"), f("b"))).collect())
    assert same == 1 and none == 0
    assert 1 > a > 0.75 and a > b  # a MinHash without order gives 1 for the moved halves
    assert 0.25 < moved < 0.75


def brute(rows: list[tuple]) -> list[tuple]:
    line = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -((xx(r[1] or "") % (1 << 64)) >> 11), r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(line):
        text, after = text or "", line[(i + 1) % len(line)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = plain(text), plain(edited), plain(after)
        near = lambda x, y: sum(p == q for p, q in zip(x, y, strict=True)) / len(x)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), near(a, b), near(a, c)))
    return sorted(out, key=str)


def test_next_documents(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(60), 7, 7, 7, 7, 7]), rng.choice(texts()[:60])) for _ in range(200)] + [(7, f"x {i}") for i in range(150)]
    df = spark.createDataFrame([(d, t, 1, 2.0, "q") for d, t in rows], "doc_id long, text string, range int, share double, numbers string").repartition(5)
    got = sorted((tuple(r) for r in fingerprints.edited_fingerprints(df).collect()), key=str)
    assert got == brute(rows)
    assert fingerprints.edited_fingerprints(df.limit(0)).collect() == []
    alone = fingerprints.edited_fingerprints(df.where("text = 'x 3'")).collect()
    assert [tuple(r) for r in alone] == brute([(7, "x 3")])


def test_query(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = sorted((tuple(r) for r in queries.QUERIES["op13_order_minhash"](spark, SF).collect()), key=str)
    assert got == brute(rows)
