"""Tool calls and URL filters against plain Python."""

import json
import random
import time

from graphloom.llm import chat, urlfilter

SCHEMA = {"add": {"a": ("number", True), "b": ("integer", True), "note": ("string", False)}, "get": {"key": ("string", True)}}


def call(i, name, arguments, *after):
    return {"id": i, "name": name, "arguments": arguments, "after": list(after)}


def links(spark, rows):
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, level string")
    return {(r["conv_id"], r["call_id"]): r for r in chat.link_calls(table, SCHEMA).collect()}


def test_links_levels_and_errors(spark):
    said = [call("1", "get", {"key": "é\"\n"}), call("2", "add", {"b": 2, "a": 1.5, "note": "x"}, "1"), call("3", "get", {"key": 5}, "2", "9"), call("4", "get", {"key": "k"}, "5"), call("5", "get", {"key": "k"}, "4"), call("6", "none", {}), call("7", "add", {"a": 1}), call("8", "get", {"key": "z"}, "2")]
    rows = [(1, 1, "assistant", json.dumps({"tool_calls": said})), (1, 2, "tool", json.dumps({"tool_call_id": "1", "content": "one"})), (1, 3, "tool", json.dumps({"tool_call_id": "1", "content": "later"}))]
    rows += [(1, 4, "tool", json.dumps({"tool_call_id": "0", "content": "lone"})), (1, 0, "tool", json.dumps({"tool_call_id": "2", "content": "too early"})), (1, 5, "user", "hello"), (1, 6, "assistant", None), (1, 7, "assistant", ""), (1, 8, "assistant", "plain"), (None, 1, "assistant", json.dumps({"tool_calls": said}))]
    rows += [(2, 1, "assistant", json.dumps({"tool_calls": [call("1", "get", {"key": "other"})]}))] * 2
    got = links(spark, rows)
    assert {k: r["level"] for k, r in got.items()} == {(1, "1"): 0, (1, "2"): 1, (1, "3"): 2, (1, "4"): None, (1, "5"): None, (1, "6"): 0, (1, "7"): 0, (1, "8"): 2, (1, "0"): None, (2, "1"): 0}
    errors = {k[1]: r["error"] for k, r in got.items() if k[0] == 1}
    assert errors == {"1": None, "2": None, "3": "key is not of type string", "4": "is on or behind a cycle", "5": "is on or behind a cycle", "6": "unknown tool", "7": "b is missing", "8": None, "0": None}
    assert {k: r["status"] for k, r in got.items() if k[1] in "012"} == {(1, "0"): "no call", (1, "1"): "linked", (1, "2"): "no result", (2, "1"): "no result"}
    assert got[1, "1"]["result_turn"] == 2
    whole = json.dumps({"after": [], "arguments": {"key": "é\"\n"}, "id": "1", "name": "get", "result": "one"}, ensure_ascii=False, separators=(",", ":"))
    assert got[1, "1"]["json"] == whole
    assert json.loads(got[1, "2"]["json"])["arguments"] == {"a": 1.5, "b": 2, "note": "x"} and '"arguments":{"a":1.5,"b":2,"note":"x"}' in got[1, "2"]["json"]


def brute_links(rows):
    """The same by plain Python, one conversation after the other."""
    out = {}
    for conv in {r[0] for r in rows}:
        calls, results = {}, {}
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[3])):
            said = json.loads(text)
            if role == "assistant":
                for c in said["tool_calls"]:
                    calls.setdefault(c["id"], (turn, c))
            else:
                results.setdefault(said["tool_call_id"], []).append((turn, said["content"]))
        levels, waiting = {}, {i: {x for x in c["after"] if x in calls} for i, (_, c) in calls.items()}
        while ready := [i for i, need in waiting.items() if need <= levels.keys()]:
            for i in ready:
                levels[i] = 1 + max((levels[x] for x in waiting[i]), default=-1)
            waiting = {i: need for i, need in waiting.items() if i not in levels}
        for i in calls.keys() | results.keys():
            turn, c = calls.get(i, (None, {}))
            late = [r for r in results.get(i, []) if turn is None or r[0] >= turn]
            status = "no call" if turn is None else "linked" if late else "no result"
            fault = None
            if turn is not None:
                unmet = sorted(x for x in c["after"] if x not in calls)
                bad = None if c["name"] == "get" and isinstance(c["arguments"].get("key"), str) else "unknown tool" if c["name"] != "get" else "key is missing" if c["arguments"].get("key") is None else "key is not of type string"
                fault = bad or (f"needs unknown call {unmet[0]}" if unmet else None) or (None if i in levels else "is on or behind a cycle")
            whole = {"after": sorted(c["after"]) if c else [], "arguments": c.get("arguments"), "id": i, "name": c.get("name"), "result": late[0][1] if late else None}
            out[conv, i] = (turn, late[0][0] if late else None, levels.get(i), status, fault, json.dumps(whole, ensure_ascii=False, separators=(",", ":"), sort_keys=True))
    return out


def test_random_conversations_against_plain_python(spark):
    rng = random.Random(21)
    rows = []
    for conv in range(60):
        n = rng.randrange(1, 14)
        ids = [f"k{i}" for i in range(n)]
        for i, x in enumerate(ids):
            others = ids[:i] if conv % 3 else ids  # every third conversation may have cycles
            after = sorted(set(rng.sample(others, min(len(others), rng.choice([0, 1, 1, 1, 2, 3])))) | ({"gone"} if rng.random() < 0.05 else set()))
            arguments = rng.choice([{"key": "v"}, {"key": "ü \"q\""}, {"key": 3}, {"key": None}, {}, {"z": [1, {"b": 1, "a": 2.5}], "key": "k"}])
            rows.append((conv, rng.randrange(n), "assistant", json.dumps({"tool_calls": [call(x, rng.choice(["get", "get", "none"]), arguments, *after)]})))
            if rng.random() < 0.8:
                rows.append((conv, rng.randrange(2 * n), "tool", json.dumps({"tool_call_id": rng.choice([x, x, "lone"]), "content": f"r{i}"})))
    got = {k: (r["call_turn"], r["result_turn"], r["level"], r["status"], r["error"], r["json"]) for k, r in links(spark, rows).items()}
    assert got == brute_links(rows)


def test_a_long_chain_takes_few_rounds(spark):
    rows = [(1, i, "assistant", json.dumps({"tool_calls": [call(f"k{i}", "get", {"key": "x" * 50}, *([f"k{i - 1}"] if i else []))]})) for i in range(1000)]
    rows += [(2, i, "assistant", json.dumps({"tool_calls": [call(f"k{i}", "get", {"key": "x"}, f"k{(i + 1) % 500}")]})) for i in range(500)]  # one cycle
    began = time.time()
    got = links(spark, rows)
    assert time.time() - began < 60
    assert all(got[1, f"k{i}"]["level"] == i for i in range(1000)) and all(got[2, f"k{i}"]["level"] is None for i in range(500))


def test_very_long_texts(spark):
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": [call("a", "get", {"key": "x" * 3_000_000})]})), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "y" * 3_000_000})), (1, 2, "assistant", "{" * 1_000_000)]
    row = links(spark, rows)[1, "a"]
    assert row["error"] is None and len(row["json"]) > 6_000_000


def test_no_messages(spark):
    assert links(spark, []) == {}


def test_conversations_as_calls(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "system", "s")], "conv_id long, turn long, role string, text string")
    rows = chat.link_calls(chat.from_turns(turns), {"reply": {"turn": ("integer", True), "prompt": ("string", True)}}).collect()
    assert sorted((r["call_id"], r["level"], r["status"], r["error"]) for r in rows) == [("c0", 0, "linked", None), ("c2", 1, "no result", None)]


def rank(edges, seeds, rounds=200, damping=0.85):
    total = {a: sum(w for x, _, w in edges if x == a) for a, _, _ in edges}
    start = {h: 1 / len(seeds) for h in seeds}
    now = dict(start)
    for _ in range(rounds):
        new = {h: (1 - damping) * s for h, s in start.items()}
        for a, b, w in edges:
            if a in now:
                new[b] = new.get(b, 0) + damping * now[a] * w / total[a]
        now = new
    return now


def test_rules_and_reputation(spark):
    rules = urlfilter.rule_table(spark, [("com", "/", "allow"), ("bad.com", "/x/", "block"), ("evil.org", "/", "block")])
    link = lambda *to: "".join(f'<a href="{x}">' for x in to)
    pages = [
        (1, "http://WWW.a.com/p?q#f", link("//one.net/x", "https://two.net", "/own")), (2, "https://sub.bad.com/x/1", ""), (3, "https://bad.com/X/", None), (4, "http://evil.org/", link("http://one.net/")),
        (5, "http://one.net/z", link("http://two.net/")), (6, "http://two.net?u", link("http://evil.org/a", "HTTP://evil.org/b")), (7, None, "x"), (8, "no-scheme.com/", ""), (9, "http://three.net", link("http://evil.org")), (10, "http://notbad.com/x/", "z" * 3_000_000), (None, "http://evil.org/q", ""),
    ]
    table = spark.createDataFrame([(*p, "r", "v") for p in pages], "page_id long, url string, html string, rule string, verdict string")
    got = {r["page_id"]: r for r in urlfilter.judge(table, rules).collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in (1, 6, 7, 8)] == [("www.a.com", "/p"), ("two.net", ""), ("", ""), ("", "")]
    assert {i: r["rule"] for i, r in got.items() if r["rule"]} == {1: "com/", 2: "bad.com/x/", 3: "com/", 4: "evil.org/", 10: "com/", None: "evil.org/"}
    edges = [("www.a.com", "one.net", 1), ("www.a.com", "two.net", 1), ("evil.org", "one.net", 1), ("one.net", "two.net", 1), ("two.net", "evil.org", 2), ("three.net", "evil.org", 1)]
    trust = rank(edges, ["www.a.com", "bad.com", "notbad.com"])
    distrust = rank([(b, a, w) for a, b, w in edges], ["sub.bad.com", "evil.org"])
    for r in got.values():
        if r["host"]:
            assert abs(r["host_trust"] - trust.get(r["host"], 0)) < 1e-5 and abs(r["host_distrust"] - distrust.get(r["host"], 0)) < 1e-5
    assert [got[i]["verdict"] for i in (5, 6, 9)] == ["block" if distrust.get(h, 0) > trust.get(h, 0) else "allow" for h in ("one.net", "two.net", "three.net")]
    assert got[9]["verdict"] == "block" and got[7]["verdict"] == "allow"


def test_ranks_of_a_graph_of_thousands_of_links(spark):
    rng = random.Random(30)
    edges = sorted({(f"h{int(rng.random() ** 2 * 400)}", f"h{rng.randrange(400)}", float(rng.randrange(1, 4))) for _ in range(4000)})
    edges = [e for e in {(a, b): (a, b, w) for a, b, w in edges}.values() if e[0] != e[1]]
    pages = [(i, f"http://h{i}/p", None) for i in range(400)]
    rules = [(f"h{i}", "/", "allow" if i % 2 else "block") for i in range(0, 400, 13)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["host"]: r for r in urlfilter.judge(table, urlfilter.rule_table(spark, rules), spark.createDataFrame(edges, "src string, dst string, weight double")).collect()}
    trust = rank(edges, [h for h, _, v in rules if v == "allow"])
    distrust = rank([(b, a, w) for a, b, w in edges], [h for h, _, v in rules if v == "block"])
    ruled = {h: v for h, _, v in rules}
    for h, r in got.items():
        good, bad = trust.get(h, 0), distrust.get(h, 0)
        assert abs(r["host_trust"] - good) < 1e-5 and abs(r["host_distrust"] - bad) < 1e-5
        assert abs(good - bad) < 2e-5 or r["verdict"] == ruled.get(h, "block" if bad > good else "allow")


def test_no_pages(spark):
    table = spark.createDataFrame([], "page_id long, url string, html string")
    assert urlfilter.judge(table, urlfilter.rule_table(spark, urlfilter.QUERY_RULES)).collect() == []
