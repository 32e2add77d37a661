"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from graphloom.llm import prefixes, queries

SF = "/root/testdata/sf0.001"


def plain(rows: list[tuple]) -> dict:
    """``rows (conv_id, turn, role, text)`` to {(smallest member, depth): the other columns}, turn by turn."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    made = {}
    for c in turns:
        base, h = c - int(np.fmod(c, 5)), zlib.crc32(str(c).encode()) % 9
        made[c] = turns.get(base, [])[:h] + turns[c][h:]
    nodes = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    child = defaultdict(list)
    for p in nodes:
        if p:
            child[p[:-1]].append(p)
    below = {}
    for p in sorted(nodes, key=len, reverse=True):
        own_saved = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below[p] = (sum(below[q][0] for q in child[p]) or 1, own_saved + sum(below[q][1] for q in child[p]))
    out = {}
    for p, members in nodes.items():
        ends = sorted(c for c in members if len(made[c]) == len(p))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out[min(members), len(p)] = (min(nodes[p[:-1]]) if p else None, len(members), len(child[p]), *below[p], digest)
    return out


def found(df) -> dict:
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


def trie(conversations):
    tokens, members = prefixes.rebuilt(prefixes.turn_tokens(conversations))
    return prefixes.prefix_trie(tokens, members)


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("stretch", [2, 7, 20_000])
def test_trie_as_a_dictionary(spark, stretch):
    rng = random.Random(stretch)
    rows = []
    for c in rng.sample(range(-40, 200), 150):
        for t in range(rng.choice([1, 1, 2, 3, 4, 9, 14])):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["", "é", "ab", None])))
    rows += [(300 + i, t, "user", "ab" * (t + 1)) for i in range(60) for t in range(10)]  # copies
    rows += [(None, 1, "user", "x"), (7, None, None, None), (7, None, None, None)]
    tokens, members = prefixes.rebuilt(prefixes.turn_tokens(table(spark, rows)))
    assert found(prefixes.prefix_trie(tokens, members, stretch)) == plain(rows)


def test_forests_of_stretches_add_up():
    """A sorted list cut anywhere: partial nodes add up to those of the whole list."""
    rng = random.Random(3)
    seqs = sorted("".join(rng.choices("ab", k=rng.randrange(0, 7))) for _ in range(80))

    def nodes(cuts):
        lcp = [-1] + [len([1 for k in range(min(len(a), len(b))) if a[: k + 1] == b[: k + 1]]) for a, b in zip(seqs, seqs[1:], strict=False)] + [-1]
        out = defaultdict(lambda: [10**9, 0, 0, 0, 0])
        parents = {}
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = seqs[a:b]
            turns = np.array([len(x) for x in part])
            keys = [hashlib.sha256(x[: d + 1].encode()).digest()[:16] for x in part for d in range(len(x))]
            upto = np.concatenate([np.arange(len(x) + 1) * 3 for x in part])
            got = prefixes.forest(np.arange(a, b), turns, np.array(lcp[a:b]), lcp[b], np.cumsum(turns) - turns, np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16), upto).to_pylist()
            for r in got:
                own = out[r["key"], r["depth"]]
                assert r["partial"] or own[1] == 0
                own[0] = min(own[0], r["conv_id"])
                for i, c in enumerate(("n_convs", "n_children", "n_leaves", "saved_tokens")):
                    own[i + 1] += r[c]
                if r["parent_conv_id"] is not None:
                    parents[r["key"], r["depth"]] = r["parent_conv_id"]
        return dict(out), parents

    whole, parents = nodes([0, 80])
    for _ in range(20):
        got, known = nodes([0, *sorted(rng.sample(range(1, 80), rng.randrange(1, 12))), 80])
        assert got == whole
        assert known.items() <= parents.items()


def test_edges_of_the_table(spark):
    assert found(trie(table(spark, []))) == {}
    rows = [(8, 0, "user", "x")]  # 5 is absent, and the own turn is among the first h
    assert zlib.crc32(b"8") % 9 > 0
    assert found(trie(table(spark, rows))) == plain(rows) == {(8, 0): (None, 1, 0, 1, 0, hashlib.sha256(b"8").hexdigest())}
    extra = table(spark, [(5, 0, "user", "x" * 100_000), (6, 0, "user", "x" * 100_000)]).selectExpr("*", "1 AS key", "2 AS place", "3 AS token", "4 AS bytes", "5 AS depth")
    assert found(trie(extra)) == plain([(5, 0, "user", "x" * 100_000), (6, 0, "user", "x" * 100_000)])


def test_query(spark):
    import duckdb

    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    assert found(queries.QUERIES["op12_prefix_trie"](spark, SF)) == plain(rows)
