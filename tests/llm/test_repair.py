"""Repairs of conversations against a search over all edits, written plainly."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from graphloom.llm import queries, repair

SF = "/root/testdata/sf0.001"
FORM = re.compile(r"(s?(ua)+)?\Z")


def cheapest(turns: list[tuple]) -> tuple[int, str, list[tuple]]:
    """``turns (role, text, fault)``: Dijkstra's search by (cost, audit) over (turns done, initials so far, cut to the last)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, made = heapq.heappop(heap)
        if i == len(turns) and last in ("", "a"):
            return cost, audit, list(made)
        if (i, last) in done:
            continue
        done.add((i, last))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        full = {"u": "user", "a": "assistant"}
        for x in follows:
            if x in full:
                heapq.heappush(heap, (cost + 5, audit + "I", i, x, (*made, (full[x], ""))))
        if i == len(turns):
            continue
        role, text, fault = turns[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, made))
        if fault in ("blank", "duplicate"):
            continue
        more = 5 if fault == "truncated" else 0
        if role[:1] and role[:1] in follows:
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*made, (role, text))))
        for x in follows:
            if x in full:
                heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, x, (*made, (full[x], text))))
    raise AssertionError


def fault_of(role, text, seen) -> str:
    body = text.strip(" \t\n\x0b\x0c\r")
    out = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
    seen.add((role, text))
    return out


def plain(rows: list[tuple], damage: bool) -> dict:
    by = defaultdict(list)
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        own = by[c]
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damage else -1
        if fate == 0:
            continue
        x = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
        r = "user" if fate == 4 else r
        own += [(t is not None, t or 0, r, x)] * (2 if fate == 3 else 1)
    out = {}
    for c, own in by.items():
        own.sort()
        seen: set = set()
        faults = [fault_of(r, x, seen) for _, _, r, x in own]
        numbers = [t for known, t, _, _ in own if known]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[:1] for _, _, r, _ in own]
        illegal = sum((a, b) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, made = cheapest([(r, x, f) for (_, _, r, x), f in zip(own, faults, strict=True)])
        assert FORM.match("".join(r[0] for r, _ in made))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def found(df) -> dict:
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def random_rows(rng, conversations, longest):
    roles = ["system", "user", "assistant", "tool", "", None, "ua", "S"]
    rows = []
    for c in conversations:
        for t in range(rng.randrange(1, longest)):
            rows.append((c, rng.choice([t, t, t, t + 3, None]), rng.choice(roles[:3] * 4 + roles), rng.choice(["a.", "b", "x! ", " \n", "", None, f"{t}?", f"{t}", "c.\n\n"])))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("damage", [False, True])
def test_repairs_as_a_search(spark, monkeypatch, damage):
    rng = random.Random(11)
    rows = random_rows(rng, [None, *range(-3, 150)], 12)
    if damage:
        rows += random_rows(rng, range(200, 203), 40) + [(999, 0, "user", "x" * 300_000 + ".")]
    df = table(spark, rows)
    monkeypatch.setattr(repair, "BLOCK", 4)  # read on the driver, as columns are made: long conversations are many blocks
    got = found(repair.audits(repair.damaged(df), df) if damage else repair.audits(df))
    assert got == plain(rows, damage)


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "hi."), (1, 1, "user", "hi."), (1, 2, "tool", "yes."), (2, 0, "assistant", "a.")]
    got = [tuple(r) for r in repair.repaired(table(spark, rows)).orderBy("conv_id", "place").collect()]
    assert got == [(1, 0, 0, "user", "hi.", "K"), (1, 1, 2, "assistant", "yes.", "R")]  # one deletion is cheaper than an insertion


def test_rules_write_the_lines():
    rng = random.Random(1)
    lines = ["".join(rng.choices("suaSUAx", k=rng.randrange(1, 60))) for _ in range(200)] + ["uuuuu" * 30]
    rules = []
    for _ in range(20):
        flat = repair.parse(lines, rules)
        pairs = defaultdict(int)
        for a, b in zip(flat, flat[1:], strict=False):
            pairs[a, b] += a >= 0 and b >= 0
        rules += [(int(a), int(b)) for (a, b), n in sorted(pairs.items(), key=lambda p: -p[1])[:8] if n > 1]
    whole = list(repair.SYMBOLS)
    for a, b in rules:
        whole.append(whole[a] + whole[b])
    flat = repair.parse(lines, rules)
    assert "".join("\n" if x < 0 else whole[x] for x in flat).split("\n")[:-1] == lines
    assert len(flat) < sum(map(len, lines)) / 2
    known = repair.rule_matrices(rules)
    for i in rng.sample(range(len(rules)), 20):
        step = repair.symbol_matrix(whole[9 + i][0])
        for x in whole[9 + i][1:]:
            step = repair.product(step, repair.symbol_matrix(x))
        flatten = lambda m: [{t: (c, r.text()) for t, (c, r) in row.items()} for row in m]
        assert flatten(known[9 + i]) == flatten(step)


def test_edges_of_the_table(spark):
    assert found(repair.audits(table(spark, []))) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = table(spark, [(gone, 0, "user", "x.")])
    nothing = hashlib.sha256(b"").hexdigest()
    assert found(repair.audits(repair.damaged(df), df)) == {gone: (0, 0, 0, 0, 0, 0, "", nothing)}
    odd = table(spark, [(1, 0, "user", "x."), (1, 1, "assistant", "y.")]).selectExpr("*", "1 AS id", "2 AS kind", "3 AS key", "4 AS fate", "5 AS audit", "6 AS block")
    assert found(repair.audits(odd))[1][5:7] == (0, "KK")


def test_query(spark):
    import duckdb

    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    assert found(queries.QUERIES["op11_grammar_repair"](spark, SF)) == plain(rows, True)
