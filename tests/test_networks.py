"""Network operators against closed forms, brute force and invariants."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from graphloom.functions import distances as fn
from graphloom.functions import kernels
from graphloom.network import Network
from graphloom.operators import align, aligner, graph, matching, metrics, pairs, search, spectral
from graphloom.operators.components import connected_components
from graphloom.sources import networks, tables
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def net(spark, edges):
    return Network.from_edges(spark.createDataFrame(edges, "src long, dst long"))


CLOSED = {
    "pair": ([(0, 1)], [0, 2]),
    "triangle": ([(0, 1), (1, 2), (0, 2)], [0, 1.5, 1.5]),
    "five": (list(itertools.combinations(range(5), 2)), [0, 1.25, 1.25, 1.25, 1.25]),
    "star": ([(0, i) for i in range(1, 5)], [0, 1, 1, 1, 2]),
    "loop only": ([(0, 0)], [1]),
    "doubled": ([(0, 1), (1, 0), (0, 1)], [0, 2]),
}


def test_spectra_of_known_graphs(spark):
    edges = [(a + 100 * i, b + 100 * i) for i, (own, _) in enumerate(CLOSED.values()) for a, b in own]
    rows = spectral.signatures(net(spark, edges), 1).where("name % 100 = 0").orderBy("name").collect()
    assert len(rows) == len(CLOSED)
    for row, (_, want) in zip(rows, CLOSED.values(), strict=True):
        assert np.allclose(row["spectrum"], want)


def brute_signature(edges, center, level):
    """Ring, spectrum and density of a ball, by walking and a dense matrix."""
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    rings = [{center}]
    for _ in range(level):
        rings.append({y for x in rings[-1] for y in near.get(x, ())} - set().union(*rings))
    ball = sorted(set().union(*rings))
    m = np.array([[float(b in near.get(a, ())) for b in ball] for a in ball])
    d = m.sum(axis=1)
    scale = np.array([1 / math.sqrt(x) if x else 0 for x in d])
    values = np.linalg.eigvalsh(np.eye(len(ball)) - scale[:, None] * m * scale)
    last = max(k for k in range(1, level + 1) if rings[k] or k == 1)
    return sorted(rings[last]), values, len(ball) / (m.sum() / 2) if m.any() else math.inf


def test_signatures_against_dense_matrices(spark):
    rng = random.Random(2)
    edges = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(45)}) + [(50, 50), (60, 61)]
    rows = spectral.signatures(net(spark, edges), 3).collect()
    assert len(rows) == 3 * len({v for e in edges for v in e})
    for r in rows:
        ring, values, density = brute_signature(edges, r["name"], r["level"])
        assert r["ring"] == ring and np.allclose(r["spectrum"], values) and r["density"] == density
    named = Network.from_edges(spark.createDataFrame([(f"p{a:02}", f"p{b:02}") for a, b in edges], "src string, dst string"))
    texts = {(r["name"], r["level"]): r for r in spectral.signatures(named, 3).collect()}
    assert all(texts[f"p{r['name']:02}", r["level"]]["ring"] == [f"p{v:02}" for v in r["ring"]] for r in rows)


def dense_spectrum(edges, weights=None):
    names = sorted({v for e in edges for v in e})
    at = {v: i for i, v in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for (a, b), w in zip(edges, weights or [1.0] * len(edges), strict=True):
        m[at[a], at[b]] = m[at[b], at[a]] = w
    scale = 1 / np.sqrt(m.sum(axis=1))
    return np.linalg.eigvalsh(np.eye(len(names)) - scale[:, None] * m * scale)


def hub_graph(rng, n, hubs):
    """Three hubs with leaves of their own and shared, leaves behind leaves, a core, equal branches; weights for some."""
    edges = {(h, hubs + i) for h in range(hubs) for i in range(n) if rng.random() < 0.4} | {(0, h) for h in range(1, hubs)} | {(0, hubs + i) for i in range(n)}
    edges |= {(hubs + i, 10_000 + i) for i in range(0, n, 3)} | {(10_000 + i, 20_000 + i) for i in range(0, n, 6)}
    edges |= {tuple(sorted(rng.sample(range(hubs, hubs + n // 2), 2))) for _ in range(n)}
    return sorted(edges)


def test_sparse_spectra_of_graphs_with_hubs():
    rng = random.Random(8)
    for n in (40, 300):
        for weighted in (False, True):
            edges = hub_graph(rng, n, 3)
            w = [rng.choice([0.5, 1.0, 2.0]) if weighted else 1.0 for _ in edges]
            names = sorted({v for e in edges for v in e})
            i, j = (np.searchsorted(names, [e[k] for e in edges]) for k in (0, 1))
            assert np.allclose(spectral.sparse_spectrum(i, j, np.array(w), len(names)), dense_spectrum(edges, w), atol=1e-9)
    leaves = np.arange(1, 50_001)
    values = spectral.sparse_spectrum(np.zeros(50_000, int), leaves, np.linspace(1, 2, 50_000), 50_001)
    assert np.allclose(values[[0, -1]], [0, 2]) and (values[1:-1] == 1).all()


def test_balls_with_hubs_have_exact_spectra(spark):
    """No ball is too large: every vertex has a spectrum at every level, and a density vector."""
    rng = random.Random(4)
    edges = hub_graph(rng, 150, 3)
    network = net(spark, edges)
    rows = spectral.signatures(network, 2).collect()
    names = {v for e in edges for v in e}
    assert len(rows) == 2 * len(names)
    for r in rows:
        ring, values, density = brute_signature(edges, r["name"], r["level"])
        assert r["ring"] == ring and np.allclose(r["spectrum"], values, atol=1e-9) and r["density"] == density
    assert spectral.vectors(network, 2).count() == len(names)
    same = {r["name"]: r["levels"] for r in spectral.vectors(network, 2).collect()}
    assert all(np.allclose(r["levels"], same[r["name"]]) for r in spectral.density_vectors(spectral.signatures(network, 2)).collect())


def test_star_of_50_000_leaves(spark):
    """Leaves are twins: rings and balls are made for the hub and one of them, and both levels of the hub and the second of a leaf are one ball."""
    star = Network.from_edges(spark.range(1, 50_001).selectExpr("0L AS src", "id AS dst"))
    found = spectral.solved_balls(star, 2)
    assert found.ring.count() == 50_000 + 1 + 49_999
    balls = sorted(found.solved.collect(), key=lambda r: r["n"])
    assert [r["n"] for r in balls] == [2, 50_001] and np.allclose(balls[0]["spectrum"], [0, 2])
    values = np.array(balls[1]["spectrum"])
    assert np.allclose(values[[0, -1]], [0, 2]) and (values[1:-1] == 1).all() and balls[1]["density"] == 50_001 / 50_000
    assert found.ball.groupBy("level", "n").count().orderBy("level", "n").collect() == [(1, 2, 50_000), (1, 50_001, 1), (2, 50_001, 50_001)]


def test_weighted_signatures_with_twins(spark):
    rng = random.Random(6)
    edges = [(0, i, rng.choice([0.6, 0.6, 1.5])) for i in range(1, 12)] + [(20, i, 0.6) for i in range(1, 6)] + [(20, 30, 0.2), (0, 30, 1.9)]
    network = Network.from_edges(spark.createDataFrame(edges, "src long, dst long, weight double"))
    got = {(r["name"], r["level"]): r for r in spectral.signatures(network, 3, weighted=True).collect()}
    ring = {}
    for r in graph.rings(network, 3, weighted=True).collect():
        ring.setdefault((r["center"], r["level"]), []).append(r["vertex"])
    for (name, level), r in got.items():
        upto = [x for x in range(1, level + 1) if (name, x) in ring]
        assert r["ring"] == (sorted(ring[name, upto[-1]]) if upto else [])
        ball = {name, *(v for x in upto for v in ring[name, x])}
        inside = [(a, b) for a, b, _ in edges if a in ball and b in ball]
        lone = len(ball) - len({v for e in inside for v in e})
        want = np.concatenate([dense_spectrum(inside, [w for a, b, w in edges if a in ball and b in ball]) if inside else [], np.ones(lone)])
        assert np.allclose(r["spectrum"], np.sort(want))


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(1000, i) for i in range(1001, 1400)] + [(2000 + i, 2001 + i) for i in range(70)] + [(None, 1)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root}


def brute_greedy(rows):
    left, right, out = set(), set(), []
    for a, b, d in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if a not in left and b not in right:
            left.add(a), right.add(b), out.append((a, b, d))
    return sorted(out)


def test_matchings_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(a, b, rng.randrange(8) / 8) for a in range(30) for b in range(30) if rng.random() < 0.15]
    table = spark.createDataFrame(rows, "left long, right long, d double")
    assert sorted(map(tuple, matching.greedy(table).collect())) == brute_greedy(rows)
    small = [(a, b, rng.random()) for a in range(6) for b in range(5) if rng.random() < 0.6]
    cost = {(a, b): d for a, b, d in small}
    best = min(sum(cost.get((a, b), 100) for a, b in zip(p, range(5), strict=False)) + 100 for p in itertools.permutations(range(6), 5))
    table = spark.createDataFrame(small, "left long, right long, d double")
    exact = matching.optimal(table).collect()
    total = sum(r["d"] for r in exact) + 100 * (6 - len(exact))
    assert math.isclose(total, best)
    auction = matching.auction(table, worth=3.0, epsilon=0.2).collect()
    least = min(sum(cost.get((a, b), 3) for a, b in zip(p, range(5), strict=False)) + 3 for p in itertools.permutations(range(6), 5))
    assert sum(r["d"] for r in auction) + 3 * (6 - len(auction)) <= least + 6 * 0.2


def test_large_components_are_matched_like_small_ones(spark):
    rng = random.Random(4)
    rows = [(a, b, rng.random() / 100) for a in range(40) for b in range(35) if rng.random() < 0.08]  # differences far below 0.06
    rows += [(50, 60, 0.0), (50, 61, 9.0), (51, 60, 9.0), (52, 60, 1.0)]  # two pairs are worth more than the nearest
    table = spark.createDataFrame(rows, "left long, right long, d double")
    small, large = (sorted(map(tuple, matching.optimal(table, exact).collect())) for exact in (2000, 1))
    assert len(small) == len(large) and math.isclose(sum(r[2] for r in small), sum(r[2] for r in large), rel_tol=1e-9)
    assert set(large) <= set(rows) and len({r[0] for r in large}) == len({r[1] for r in large}) == len(large)
    assert {r for r in large if r[0] >= 50} == {(50, 61, 9.0), (52, 60, 1.0)}
    odd = spark.createDataFrame([(0, 0, 150.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 250.0), (2, 2, 150.0), (3, 3, 100.0)], "left long, right long, d double")
    assert all(sorted(map(tuple, matching.optimal(odd, exact).collect())) == [(0, 1, 1.0), (1, 0, 1.0)] for exact in (2000, 1))


@pytest.mark.parametrize("seed", range(40))
def test_both_solvers_at_one_cost(seed):
    """Costs around that of no partner, ties among them."""
    rng = np.random.default_rng(seed)
    cells = [(a, b) for a in range(rng.integers(1, 25)) for b in range(rng.integers(1, 25)) if rng.random() < 0.3] or [(0, 0)]
    frame = pd.DataFrame(cells, columns=["left", "right"])
    frame["d"] = rng.integers(0, 9, len(cells)) * 20.0 if seed % 2 else rng.uniform(60, 120, len(cells))
    one, two = (solve(frame) for solve in (matching.solve_frame, matching.solve_sparse))
    for got in (one, two):
        assert got["left"].is_unique and got["right"].is_unique and (got["d"] < matching.PAD).all()
    worth = [(matching.PAD - x["d"]).sum() for x in (one, two)]
    assert math.isclose(*worth, abs_tol=1e-6)


@pytest.mark.parametrize("most", [50, 10**6])
def test_greedy_on_chains(spark, monkeypatch, most):
    """A chain of better and better pairs, which mutually best pairs take one at a time."""
    rng = random.Random(most)
    n = 60 if most == 50 else 4000
    rows = [(i // 2 + i % 2, i // 2, n - i) for i in range(n)] + [(10_000 + rng.randrange(60), 10_000 + rng.randrange(60), float(rng.randrange(9))) for _ in range(300)]
    rows = [(a, b, float(d)) for (a, b), d in {(a, b): d for a, b, d in rows}.items()]
    steps = []
    monkeypatch.setattr(matching, "mutual_best", lambda p, f=matching.mutual_best: steps.append(1) or f(p))
    got = matching.greedy(spark.createDataFrame(rows, "left long, right long, d double"), most=most).collect()
    assert sorted(map(tuple, got)) == brute_greedy(rows)
    assert most == 50 or len(steps) < 10


def test_greedy_of_equal_vertices_looks_for_no_components(spark, monkeypatch):
    """Left vertices that want the same right ones: a pair of each such group a round, as in copies of a network."""
    rows = [(10 * g + a, 10 * g + b, float(b // 3)) for g in range(5) for a in range(9) for b in range(8)]
    monkeypatch.setattr(matching, "_components", None)
    got = matching.greedy(spark.createDataFrame(rows, "left long, right long, d double")).collect()
    assert sorted(map(tuple, got)) == brute_greedy(rows)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 6), st.integers(0, 10**6))
def test_assignment(n, seed):
    cost = np.random.default_rng(seed).integers(0, 20, (n, n)).astype(float)
    columns = matching.assign(cost)
    assert sorted(columns) == list(range(n))
    assert cost[np.arange(n), columns].sum() == min(cost[np.arange(n), list(p)].sum() for p in itertools.permutations(range(n)))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=4, max_size=4), st.lists(st.floats(0, 1), min_size=4, max_size=4))
def test_js_is_a_bounded_symmetric_distance(p, q):
    p, q = (np.array(x) + 1e-3 for x in (p, q))
    p, q = p / p.sum(), q / q.sum()
    assert kernels.js(p, p) == 0 and math.isclose(kernels.js(p, q), kernels.js(q, p), abs_tol=1e-9)
    assert kernels.js(p, q) <= math.sqrt(math.log(2)) + 1e-9


def test_columns_and_kernels_agree(spark):
    rng = np.random.default_rng(9)
    spectra = [np.sort(rng.uniform(0, 2, rng.integers(1, 9))) for _ in range(6)]
    table = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(spectra)], "i long, s array<double>")
    got = np.array([r["v"] for r in table.select("i", fn.density_vector(F.col("s")).alias("v")).orderBy("i").collect()])
    want = kernels.density_vectors(spectra)
    assert np.allclose(got, want)
    block = kernels.js_block(want, want)
    assert np.allclose(block, [[kernels.js(a, b) for b in want] for a in want], atol=1e-7) and (np.diag(block) == 0).all()


def random_networks(spark, seed=4, n=24, m=50):
    rng = random.Random(seed)
    edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
    return net(spark, edges), net(spark, [e for e in edges if (e[0] * 31 + e[1] * 17) % 10])


def test_structural_distances_match_pairs(spark):
    left, right = random_networks(spark)
    a, b = (spectral.density_vectors(spectral.signatures(x, 2)) for x in (left, right))
    got = {(r["left"], r["right"]): r["d_struct"] for r in pairs.structural_distances(a, b, block=5).collect()}
    one, two = ({r["name"]: np.array(r["levels"]) for r in t.collect()} for t in (a, b))
    want = {(x, y): kernels.js(p, q).mean() for x, p in one.items() for y, q in two.items()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-7) for k in want)
    near = pairs.structural_distances(a, b, k=3, block=5).collect()
    for x in one:
        own = sorted(r["d_struct"] for r in near if r["left"] == x)
        assert np.allclose(own, sorted(d for (l, _), d in want.items() if l == x)[:3], atol=1e-7)


@pytest.mark.parametrize("k", [1, 5])
def test_bounded_nearest_equal_all_pairs(k):
    rng = np.random.default_rng(1)
    spectra = [np.round(rng.uniform(0, 2, rng.integers(1, 9)), 2) for _ in range(300)]
    v = np.stack([kernels.density_vectors(spectra), kernels.density_vectors(spectra[::-1])], axis=1)
    a, b = v[:120], np.concatenate([v[100:], v[100:120]])  # some equal, some twice
    d = kernels.js_all(a, b)
    i, j, found = kernels.js_nearest(a, b, k)
    want = d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    got = np.zeros_like(want)
    got[i, j] = True
    assert (got == want).all() and np.allclose(d[i, j], found, atol=1e-9)


@pytest.mark.parametrize(("seeds", "few"), [(1, 0), (None, 0), (None, 10**9)])
def test_alignment_covers_and_keeps_beta(spark, monkeypatch, seeds, few):
    monkeypatch.setattr(align, "FEW", few)
    left, right = random_networks(spark, n=14, m=24)
    names = [(a, b) for a in range(14) for b in range(14)]
    table = spark.createDataFrame([(a, b, abs(a - b) / 14 + (a * 7 + b) % 5 / 50, 0.5 if (a + b) % 3 else 1.1) for a, b in names], "left long, right long, d double, d_seq double")
    found = align.seed_and_extend(left, right, table, beta=1.0, seeds_per_round=seeds).collect()
    assert len({r["left"] for r in found}) == len({r["right"] for r in found}) == len(found) == min(left.vertices.count(), right.vertices.count())
    assert all((r["left"] + r["right"]) % 3 for r in found if r["score"] != 1.0)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_last_rounds_of_seeds_in_one_task(spark, monkeypatch, kind):
    """All rounds by joins, by one task, and the last ones by one task, on pairs with ties, aligned sides and a sequence limit."""
    rng = random.Random(8)
    left, right = random_networks(spark, n=40, m=70)
    left, right = (Network.from_edges(x.edges.withColumns({c: F.col(c).cast(kind) for c in ("src", "dst")})) for x in (left, right))
    rows = [(a, b, rng.randrange(12) / 12, rng.choice([0.5, 0.5, 1.1])) for a in range(40) for b in range(40) if rng.random() < 0.3]
    table = spark.createDataFrame(rows, "left long, right long, d double, d_seq double").withColumns({c: F.col(c).cast(kind) for c in ("left", "right")})
    steps, got = [], []
    monkeypatch.setattr(align, "extend", lambda *a, f=align.extend: steps.append(1) or f(*a))
    for most in (0, 200, align.MOST):
        steps.clear()
        found = align.seed_and_extend(left, right, table, k=3, beta=1.0, most=most)
        got.append((sorted(map(tuple, found.collect())), len(steps)))
    (by_joins, all_), (mixed, some), (by_task, none) = got
    assert by_joins == mixed == by_task and all_ > some > none == 0


def test_extension_along_pairs_and_along_neighbours(spark):
    """A frontier of several seeds, with few pairs of a left vertex or all of them."""
    rng = random.Random(21)
    left, right = random_networks(spark, n=14, m=30)
    rows = [(a, b, rng.random(), rng.choice([0.5, 1.1])) for a in range(14) for b in range(14) if rng.random() < 0.7]
    table = spark.createDataFrame(rows, "left long, right long, d double, d_seq double")
    frontier = spark.createDataFrame([(0, 1, 0.1), (5, 3, 0.2), (9, 9, 0.3)], "left long, right long, score double")
    near = [align._with_self(x) for x in (left, right)]
    got = [sorted(map(tuple, align.extend(frontier, frontier, table, *near, 3, 1.0, few).collect())) for few in (False, True)]
    assert got[0] == got[1] and got[0]
    sides = [{}, {}]
    for side, one in zip(sides, near, strict=True):
        for r in one.collect():
            side.setdefault(r["name"], set()).add(r["neighbour"])
    best = {}
    for a, b, s in frontier.collect():
        kept = []
        for x in sides[0].get(a, ()):
            kept += sorted((r for r in rows if r[0] == x and r[1] in sides[1].get(b, ())), key=lambda r: (r[2], r[1]))[:3]
        kept = [r for r in kept if r[0] not in (0, 5, 9) and r[1] not in (1, 3, 9)]
        frame = pd.DataFrame(kept, columns=["left", "right", "d", "d_seq"])
        for r in (frame if len(frame) <= 1 else matching.solve_frame(frame)).itertuples(index=False):
            if r.d_seq <= 1.0:
                best[r.left, r.right] = min(best.get((r.left, r.right), (9, 9)), (s, r.d))
    want = brute_greedy([(a, b, o) for (a, b), o in best.items()])
    assert got[0] == [(a, b, o[1]) for a, b, o in want]


def test_whole_alignments_from_vectors_and_scores(spark):
    left, right = random_networks(spark, n=14, m=24)
    scores = spark.createDataFrame([(a, (a * 3) % 14, float(a)) for a in range(14)], "left long, right long, d double")
    vectors = [spectral.vectors(x, 2) for x in (left, right)]
    few = aligner.candidates(*vectors, scores, 2)
    every = {(r["left"], r["right"]): r["d_struct"] for r in aligner.candidates(*vectors, None, None).collect()}
    asked = {(a, (a * 3) % 14) for a in range(14)} & set(every)
    got = {(r["left"], r["right"]): r["d_struct"] for r in few.collect()}
    assert asked <= set(got) and all(math.isclose(d, every[p], abs_tol=1e-9) for p, d in got.items()) and few.count() == len(got)
    for nearest in (None, 3):
        found = aligner.align_networks(left, right, *vectors, scores, beta=10.0, iterations=2, nearest=nearest).collect()
        assert len({r["left"] for r in found}) == len({r["right"] for r in found}) == len(found) == min(left.vertices.count(), right.vertices.count())


def test_search_never_loses_edges_and_deltas_are_exact(spark):
    left, right = random_networks(spark)
    names = sorted(r["name"] for r in left.vertices.intersect(right.vertices).collect())
    shuffled = names[:]
    random.Random(1).shuffle(shuffled)
    start = spark.createDataFrame([(a, b, 0.0) for a, b in zip(names, shuffled, strict=True)], "left long, right long, score double")
    g, h = ({tuple(r) for r in x.edges.select("src", "dst").collect()} for x in (left, right))
    kept = lambda f: sum(tuple(sorted((f[a], f[b]))) in h for a, b in g if a in f and b in f)
    before = dict(zip(names, shuffled, strict=True))
    found = search.moves(start, left.edges, right.edges).collect()
    assert found
    for r in found:
        after = before | {r["left"]: r["new"]} | ({r["other"]: r["old"]} if r["other"] is not None else {})
        assert kept(after) - kept(before) == r["delta"]
    better = search.improve(left, right, start, iterations=2).collect()
    end = {r["left"]: r["right"] for r in better}
    assert len(set(end.values())) == len(end) and kept(end) > kept(before)
    assert math.isclose(sum(search.budget(i, 5, 0.7) for i in range(5)), 0.7)


def test_metrics_of_the_identity(spark):
    left, _ = random_networks(spark)
    same = metrics.keyed(left.vertices.select(F.col("name").alias("left"), F.col("name").alias("right")))
    row = metrics.alignment_statistics(same, left.edges, left.edges).first()
    assert row["ec"] == left.edges.count() and row["ics"] == 100 and metrics.conservation(same, left.edges, left.edges).first()["edge_correctness"] == 1


def test_alignment_changes(spark):
    now = spark.createDataFrame([(1, 1, 0.5), (2, 2, 0.1), (3, 3, 0.9)], "left long, right long, score double")
    new = spark.createDataFrame([(1, 3, 0.4), (4, 2, 0.3)], "left long, right long, score double")
    assert sorted(map(tuple, matching.insert_if_better(now, new).collect())) == [(1, 3, 0.4), (2, 2, 0.1)]
    kept, out = matching.force_insert(now, new)
    assert sorted(map(tuple, kept.collect())) == [(1, 3, 0.4), (4, 2, 0.3)] and out.count() == 3
    assert matching.insert_if_free(now, new).count() == 3


def test_hitting_times_of_a_path(spark):
    path = net(spark, [(0, 1), (1, 2)])
    target = spark.createDataFrame([(2,)], "name long")
    got = {r["name"]: r["hitting"] for r in graph.hitting_time(path.edges, target).collect()}
    assert all(math.isclose(got[k], v, rel_tol=1e-3, abs_tol=1e-9) for k, v in {0: 4, 1: 3, 2: 0}.items())


def dense_laplacian(edges):
    names = sorted({v for e in edges for v in e[:2]})
    m = np.zeros((len(names), len(names)))
    for a, b, *w in edges:
        m[names.index(a), names.index(b)] = m[names.index(b), names.index(a)] = w[0] if w else 1.0
    d = m.sum(axis=1)
    return names, np.eye(len(names)) - m / np.sqrt(d[:, None] * d), d


def test_spectrum_of_a_network(spark):
    star = [(0, i) for i in range(1, 5)]
    values, _, volumes = spectral.network_spectrum(net(spark, star), top=4)
    assert np.allclose([r["eigenvalue"] for r in values.orderBy("rank").collect()], [2, 1, 1, 1])  # with repeated ones
    assert {r["name"]: r["volume"] for r in volumes.collect()} == {0: 4, 1: 1, 2: 1, 3: 1, 4: 1}
    rng = random.Random(11)
    edges = sorted({tuple(sorted(rng.sample(range(16), 2))) for _ in range(40)})
    weighted = [(a, b, 1.0, 0.5 + (a + b) % 3) for a, b in edges] + [(100, 101, 1.0, 1.0)]  # a smaller component
    table = Network.from_edges(spark.createDataFrame(weighted, "src long, dst long, weight double, seq_weight double"))
    values, vectors, _ = spectral.network_spectrum(table, top=3, tolerance=1e-7, use_sequences=True)
    names, matrix, _ = dense_laplacian([(a, b, s) for a, b, _, s in weighted[:-1]])
    want = np.linalg.eigvalsh(matrix)[::-1][:3]
    assert np.allclose([r["eigenvalue"] for r in values.orderBy("rank").collect()], want, atol=1e-9)
    for rank in range(3):
        x = np.array([r["x"] for r in vectors.where(F.col("rank") == rank).orderBy("name").collect()])
        assert len(x) == len(names) and np.linalg.norm(matrix @ x - want[rank] * x) < 1e-6 and math.isclose(np.linalg.norm(x), 1, rel_tol=1e-9)
    with pytest.raises(ValueError, match="settled"):
        spectral.network_spectrum(table, top=3, tolerance=1e-12, most_steps=4)


GEXF = """<?xml version="1.0"?><gexf><graph><attributes class="node"><attribute id="0" title="gname" type="string"/><attribute id="1" title="other" type="string"/></attributes>
<nodes><node id="a" label="x"><attvalues><attvalue for="0" value="P1"/><attvalue for="1" value="no"/></attvalues></node><node id="b" label="y"><attvalues><attvalue for="0" value="P2"/></attvalues></node></nodes>
<edges><edge id="0" source="b" target="a" weight="0.5"/><edge id="1" source="a" target="a"/></edges></graph></gexf>"""


def test_sources(spark, tmp_path):
    (tmp_path / "g.gexf").write_text(GEXF)
    got = networks.read_gexf(spark, str(tmp_path / "g.gexf"))
    assert sorted(map(tuple, got.edges.select("src", "dst", "weight").collect())) == [("P1", "P1", 1.0), ("P1", "P2", 0.5)]
    (tmp_path / "e.txt").write_text("P1 P2 {'weight': 0.75, 'src': 'x'}\nP3 P1\nP4 P5 {'k': 1}\n")
    got = networks.read_edge_list(spark, str(tmp_path / "e.txt"))
    assert sorted(map(tuple, got.edges.select("src", "dst", "weight").collect())) == [("P1", "P2", 0.75), ("P1", "P3", 1.0)]
    (tmp_path / "b.tsv").write_text("# comment\na b 1 2 3 4 5 6 7 8 1e-5 50\na b 1 2 3 4 5 6 7 8 1e-9 60\na a 1 2 3 4 5 6 7 8 0.0 99\n")
    blast = tables.read_blast(spark, str(tmp_path / "b.tsv"), 10)
    assert sorted(map(tuple, blast.collect())) == [("a", "a", 0.0), ("a", "b", 1e-9)] and tables.self_scores(blast).count() == 1
    (tmp_path / "s.fasta").write_text(">p1 words\nABC\nDE\n>p2\nXY\n")
    assert sorted(map(tuple, networks.read_fasta(spark, str(tmp_path / "s.fasta")).collect())) == [("p1", "ABCDE"), ("p2", "XY")]
    (tmp_path / "t.rgf").write_text("2\t1\nT1\tAspect=molecular_function\tk=v\nT2\tAspect=x\nT1\tT2\n")
    terms, edges = tables.read_term_graph(spark, str(tmp_path / "t.rgf"))
    assert {r["name"]: r["attrs"] for r in terms.collect()}["T1"] == {"Aspect": "molecular_function", "k": "v"} and list(map(tuple, edges.collect())) == [("T1", "T2")]
    signature = spectral.signatures(net(spark, [(0, 1), (1, 2)]), 2)
    tables.write_signatures(signature, "g", str(tmp_path / "sig"))
    assert sorted(map(str, tables.read_signatures(spark, str(tmp_path / "sig"), "g").select(signature.columns).collect())) == sorted(map(str, signature.collect()))
    tables.write_simple_signatures(signature, str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).count() == 3
    (tmp_path / "al").mkdir()
    (tmp_path / "al" / "one.aln").write_text("a b\nc\td\n")
    assert tables.read_alignments(spark, str(tmp_path / "al")).select("left", "right").count() == 2


def test_flows_at_the_bound_stay(spark):
    # 0.1 thrice: the rounded mean is over each of them; nine equal ones and a lower one: right at mean - 3 deviations
    rows = [(1, 1, v, 0.1) for v in range(3)] + [(2, 1, v, 0.7) for v in range(9)] + [(2, 1, 9, 0.4), (3, 1, 1, None), (3, 1, 2, float("nan"))]
    rows += [(4, 1, v, 5.0) for v in range(30)] + [(4, 1, 30, 1.0)]
    flows = spark.createDataFrame(rows, "center long, level int, vertex long, flow double").coalesce(1)
    kept = {tuple(r) for r in graph.flow_cutoff(flows).select("center", "vertex").collect()}
    assert kept == {(c, v) for c, n in ((1, 3), (2, 10), (4, 30)) for v in range(n)}


def test_stats_of_differences_need_no_pairs(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 5.5), (1, None), (2, 7.0), (None, 90.0), (None, 1.0)], "g int, x double")
    both = rows.join(rows.withColumnsRenamed({"x": "y"}), "g").select(F.abs(F.col("x") - F.col("y")).alias("d"))
    want = both.agg(F.count("*").alias("n"), F.min("d").alias("least"), F.max("d").alias("most")).first()
    found = pairs.difference_stats(rows, ["g"], "x")
    assert found.first() == want == (10, 0.0, 3.5)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("names", ["long", "string"])
def test_thinned_pairs_have_the_same_nearest(spark, names):
    rng = random.Random(3)
    rows = [(rng.randrange(9), r, rng.choice([None, float("nan"), 0.5, 1.0, 2.0, rng.random()])) for r in range(400)]
    table = spark.createDataFrame(rows, "left long, right long, d double").select(F.col("left").cast(names), F.col("right").cast(names), "d").repartition(3)
    for by in (None, -F.col("d")):
        one, two = (sorted(map(str, pairs.nearest(table, 4, by, thin=thin).collect())) for thin in (False, True))
        assert one == two and len(one) == 36


def test_smallest_distinct_of_many_equal_values(spark):
    table = spark.range(20000, numPartitions=3).select(F.col("id").alias("left"), (F.col("id") % 50 / 10).alias("d"))
    assert [r[0] for r in pairs.smallest_distinct(table, 7).collect()] == [i / 10 for i in range(7)]
    assert [r[0] for r in pairs.smallest_distinct(table, 60).collect()] == [i / 10 for i in range(50)]
    assert pairs.smallest_distinct(table.limit(0), 7).count() == 0


def test_pair_queries_shuffle_parts_not_pairs(spark, tmp_path):
    from graphloom.plans.queries import QUERIES

    rows = [(i, f"b{i % 2}", i % 3, 900.0 + i * 7 % 400) for i in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    for name in ("seq_scores_beta", "pair_blend", "blast_normalise", "rank_blend"):
        found = QUERIES[name](spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(p_brand" in plan and "hashpartitioning(left" not in plan and "hashpartitioning(right" not in plan
        assert found.count() > 0


def test_greedy_by_lists_takes_what_greedy_takes(spark):
    rng = random.Random(5)
    rows = [(g, g * 100 + rng.randrange(30), g * 100 + rng.randrange(25), rng.choice([0.1, 0.2, rng.random()])) for g in range(3) for _ in range(400)]
    rows += [(9, 900 + i, 900 + j, 1 - 0.01 * (i + j)) for i in range(20) for j in (i, i + 1)]  # a chain of better and better pairs
    rows += [(8, 800, 800, 0.5)] * 9 + [(8, 800, 801, None)]
    table = spark.createDataFrame(rows, "g int, left long, right long, d double").repartition(4)
    want, free = [], set()
    for _, a, b, d in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[3], r[1], r[2])):
        if not free & {("l", a), ("r", b)}:
            free |= {("l", a), ("r", b)}
            want.append((a, b, d))
    for k in (1, 2, 16):
        assert sorted(map(tuple, matching.greedy_by_lists(table, ["g"], k).collect())) == sorted(want)
    parts = matching._either_best(2, 50)(iter([]))
    assert not list(parts)
    names = table.withColumns({c: F.col(c).cast("string") for c in ("left", "right")})
    assert len(matching.greedy_by_lists(names, ["g"], 2).collect()) == len(want)


def test_second_visits_are_counted_without_grouping(spark):
    rng = random.Random(8)
    rows = [(g, g * 100 + i, g * 100 + j, rng.choice([0.3, 0.6, rng.random()])) for g in range(2) for i in range(12) for j in range(10) if rng.random() < 0.7]
    table = spark.createDataFrame(rows, "g int, left long, right long, d double")
    near = pairs.nearest(table, 3).select("left", "right", "d")
    want = matching.by_visits(near.union(table.select("left", "right", "d")))
    found = matching.by_second_visits(table, near, ["g"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_nearest_among_relabelled_copies(spark):
    """Copies of a network have its spectra but for rounding, so ties are decided by names and vectors stay as many."""
    rng = random.Random(12)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(70)})
    copies = []
    for i in range(5):
        order = rng.sample(range(40), 40)
        copies += [(100 * i + order[a], 100 * i + order[b]) for a, b in edges]
    one, many = (spectral.vectors(net(spark, x), 2) for x in (edges, copies))
    assert many.select("levels").distinct().count() == one.select("levels").distinct().count()
    rows = {r["name"]: np.array(r["levels"]) for r in many.collect()}
    names = sorted(rows)
    d = kernels.js_all(*[np.stack([rows[x] for x in names])] * 2)
    got = {}
    for r in pairs.structural_distances(many, many, k=4, block=9).orderBy("d_struct", "right").collect():
        got.setdefault(r["left"], []).append((r["right"], r["d_struct"]))
    for i, x in enumerate(names):
        want = sorted((round(v, 7), y) for v, y in zip(d[i].tolist(), names, strict=True))[:4]
        assert [y for y, _ in got[x]] == [y for _, y in want] and np.allclose([v for _, v in got[x]], [v for v, _ in want], atol=1e-6)


def grouped_pairs(spark, seed):
    rng = random.Random(seed)
    value = {(g, a, b): rng.choice([None, rng.random(), rng.random()]) for g in range(3) for a in range(40) for b in range(36)}
    table = spark.createDataFrame([(g, g * 100 + a, g * 100 + b, d) for (g, a, b), d in value.items()], "g int, left long, right long, d double")
    make = lambda left, right: table.join(left.withColumnRenamed("name", "left"), "left").join(right.withColumnRenamed("name", "right"), "right")
    return table, make, *(table.select(F.col(c).alias("name")).distinct() for c in ("left", "right"))


def test_nearest_of_groups_are_bounded(spark):
    table, make, left, right = grouped_pairs(spark, 11)
    want = sorted(map(str, pairs.nearest(table, 4).select("left", "right", "d").collect()))
    for share in (1, 3, 32):
        assert sorted(map(str, pairs.nearest_within(make, left, right, 4, ["g"], share).select("left", "right", "d").collect())) == want


def test_thin_groups_are_matched_by_their_pairs(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(a, b, rng.random()) for a in range(600) for b in rng.sample(range(600), 5)]
    frame = pd.DataFrame(rows, columns=["left", "right", "d"])
    monkeypatch.setattr(matching, "assign", lambda cost: pytest.fail("a matrix of 360,000 places for 3,000 pairs"))
    found = matching._solve(["left", "right", "d"], matching.EXACT)(frame)
    assert len(found) > 550 and found["left"].is_unique and found["right"].is_unique
    monkeypatch.undo()
    table, _, _, _ = grouped_pairs(spark, 13)
    one, two = (sorted(map(tuple, matching.optimal(table, within=within).select("left", "right", "d").collect())) for within in (["g"], ()))
    assert one == two and len(one) == 108


def test_rounds_of_groups_make_pairs_of_free_vertices_only(spark):
    table, make, left, right = grouped_pairs(spark, 14)
    table = table.where("d IS NOT NULL")
    made = []

    def counted(a, b):
        made.append((a.count(), b.count()))
        return make(a, b).where("d IS NOT NULL")

    want = sorted(map(tuple, matching.iterative(table.select("left", "right", "d"), 3).collect()))
    names = [x.withColumn("g", F.floor(F.col("name") / 100).cast("int")) for x in (left, right)]
    for most in (10**6, 300):  # at once by tasks; after rounds of joins
        made.clear()
        assert sorted(map(tuple, matching.iterative_within(counted, *names, ["g"], 3, most).collect())) == want
        assert made[0][0] == 120 and (most > 300 or made[-1][0] < 60)


def test_distances_of_edges_are_made_once_by_arrays(spark):
    rng = np.random.default_rng(15)
    stacks = rng.dirichlet(np.ones(6), (9, 2))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(stacks[:8])], "name long, levels array<array<double>>")
    edges = spark.createDataFrame([(0, 1), (1, 0), (5, 2), (2, 7), (3, 3), (8, 1)], "src long, dst long")  # 8 has no vector
    found = pairs.edge_distances(edges, vectors)
    want = vectors.crossJoin(vectors.withColumnsRenamed({"name": "b", "levels": "q"})).select("name", "b", fn.structural_distance(F.col("levels"), F.col("q")).alias("e"))
    want = {(r[0], r[1]): r[2] for r in want.collect()}
    rows = {(r["a"], r["b"]): r["e"] for r in found.collect()}
    assert sorted(rows) == [(0, 1), (2, 5), (2, 7), (3, 3)] and all(math.isclose(rows[x], want[x], abs_tol=1e-12) for x in rows)


@pytest.mark.parametrize(("n", "m", "held"), [(40, 40, True), (40, 40, False), (30, 47, True), (1, 1, True), (1, 3, False), (60, 60, False)])
def test_all_pairs_are_assigned_row_by_row(monkeypatch, n, m, held):
    rng = np.random.default_rng(n + m)
    monkeypatch.setattr(matching, "COST_BYTES", 8 * n * m if held else 8 * m)
    for cost in (rng.random((n, m)), np.round(rng.random((n, m)), 1), np.where(rng.random((n, m)) < 0.9, matching.PAD, rng.random((n, m)))):
        at = matching.assign_all(n, m, lambda a, b, cost=cost: cost[a:b])
        assert len(set(at.tolist())) == n and math.isclose(cost[np.arange(n), at].sum(), cost[np.arange(n), matching.assign(cost)].sum(), rel_tol=1e-9)


def test_assignment_of_parts_is_among_all_pairs(spark, tmp_path):
    """Vertices whose five nearest are all taken get another; parts without a group have no pair."""
    from graphloom.plans import fixtures as fx
    from graphloom.plans.queries import QUERIES

    rng = random.Random(3)
    rows = [(i * 3, f"b{i % 2}", 1, 900.0 + rng.randrange(300)) for i in range(80)] + [(301, "b0", 1, None), (302, "b1", None, 901.0), (303, None, 1, 901.0), (304, "b9", 1, 950.0)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    every = pairs.blended(fx.pairs(spark, str(tmp_path)), 0.5).select("left", "right", "d").collect()
    d = {(r["left"], r["right"]): r["d"] for r in every}
    found = {(r["left"], r["right"]): r["d"] for r in QUERIES["lap_match"](spark, str(tmp_path)).collect()}
    assert all(found[x] == d[x] for x in found) and len({a for a, _ in found}) == len({b for _, b in found}) == len(found) == 81
    want = matching.solve_frame(pd.DataFrame([(*k, v) for k, v in d.items()], columns=["left", "right", "d"]))
    assert math.isclose(sum(found.values()), want["d"].sum(), rel_tol=1e-9)


def test_profiles_are_the_vectors_of_signatures(spark):
    left, _ = random_networks(spark, 21, 40, 45)
    found = spectral.profiles(left, 2)
    want = {r["name"]: np.array(r["levels"]) for r in spectral.density_vectors(spectral.signatures(left, 2)).collect()}
    got = {r["name"]: np.array(r["levels"]) for r in spectral.vectors(left, 2).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[x], want[x], atol=1e-9) for x in want)
    assert found.distinct.count() == found.distinct.select("levels").distinct().count() == len({x.tobytes() for x in got.values()}) < len(got)


def test_greedy_takes_from_all_pairs_of_vectors(spark):
    """Vertices whose nearest are all taken get what is left; equal vectors and equal distances go by name."""
    left, right = random_networks(spark, 22, 36, 40)
    a, b = (spectral.profiles(x, 2) for x in (left, right))
    names = [{r["name"]: np.array(r["levels"]) for r in p.names.join(p.distinct.select(F.struct("a", "b").alias("id"), "levels"), "id").collect()} for p in (a, b)]
    (ls, one), (rs, two) = ((sorted(x), np.stack([x[k] for k in sorted(x)])) for x in names)
    i, j = (x.ravel() for x in np.indices((len(ls), len(rs))))
    d = kernels.js_pairs(one, two, i, j)
    want, free = [], set()
    for x, l, r in sorted(zip(d.tolist(), (ls[k] for k in i), (rs[k] for k in j), strict=True)):  # noqa: E741
        if not free & {("l", l), ("r", r)}:
            free |= {("l", l), ("r", r)}
            want.append((l, r, x))
    assert len(want) == min(len(ls), len(rs))
    for k, most in ((2, 40), (16, 10**6)):
        assert sorted(map(tuple, matching.greedy_of_profiles(a, b, k, most).collect())) == sorted(want)
    near = matching.greedy(pairs.structural_distances(a, b, k=2).select("left", "right", F.col("d_struct").alias("d")))
    assert near.count() < len(want)  # what lists of two alone leave out


def test_distances_of_asked_pairs_are_made_once_by_arrays(spark):
    left, right = random_networks(spark, 23, 30, 40)
    vectors = [spectral.vectors(x, 2) for x in (left, right)]
    scores = spark.createDataFrame([(i, j, 0.5) for i in range(0, 30, 2) for j in range(30)] * 2 + [(1, 999, 0.5)], "left long, right long, d double")
    every = {(r["left"], r["right"]): r["d_struct"] for r in pairs.structural_distances(*vectors).collect()}
    found = aligner.candidates(*vectors, scores, 2)
    plan = found._jdf.queryExecution().toString()
    assert "zip_with" not in plan and "aggregate(" not in plan.split("== Optimized")[0].lower().replace("aggregate [", "")
    rows = {(r["left"], r["right"]): r["d_struct"] for r in found.collect()}
    assert found.count() == len(rows) and all(math.isclose(rows[x], every[x], abs_tol=1e-9) for x in rows)
    assert {x for x in every if x[0] % 2 == 0} <= rows.keys() and len({a for a, _ in rows}) == len({a for a, _ in every})


def test_search_finds_moves_once_for_all_iterations(spark, monkeypatch):
    left, right = random_networks(spark, 24, 30, 60)
    names = left.vertices.select(F.col("name").alias("left"), (29 - F.col("name")).alias("right"), F.lit(0.0).alias("score"))
    scores = spark.createDataFrame([(i, j, ((i * 7 + j * 3) % 10) / 10) for i in range(30) for j in range(30)], "left long, right long, d double")
    steps, applied = [search.steps_of(x.edges) for x in (left, right)], []
    now, count = search.align.fill(left, right, names), 0
    for i in range(4):  # an iteration at a time, each until it allows no move
        while True:
            found = search.moves(now, left.edges, right.edges, scores, 0.5, search.constrained(F.col("left"), i, search.budget(i, 4)))
            kept = search.cut(search.independent(search.cut(search.best_moves(found)), steps[0]))
            if kept.isEmpty():
                break
            now, count = search.cut(search.apply_moves(now, kept, scores, 0.5)), count + 1
    made = search._moves
    monkeypatch.setattr(search, "_moves", lambda *a: applied.append(1) or made(*a))
    got = search.improve(left, right, names, scores, 0.5, 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, now.collect())) and len(applied) == count + 1


def test_nearest_of_parts_need_no_rows_for_pairs(spark, tmp_path):
    from graphloom.plans import fixtures as fx
    from graphloom.plans.queries import QUERIES

    rows = [(i * 1009 % 4001, f"b{i % 3}", i % 2, 900.0 + i * 7 % 40) for i in range(70)] + [(9001, "b0", 0, None), (9002, "b1", None, 901.0), (9003, "b9", 1, 950.0)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    every = pairs.blended(fx.pairs(spark, str(tmp_path)), 0.5).select("left", "right", "d")
    parts = fx.dealt_parts(spark, str(tmp_path))
    for k, most in ((1, 1 << 22), (5, 30), (99, 1)):
        found = pairs.nearest_among(parts, parts, fx.GROUP, fx.blended_costs, k, "long", most)
        want = pairs.nearest(every, k).select("left", "right", "d", "rank")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    plan = QUERIES["knn_topk"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    assert QUERIES["knn_topk"](spark, str(tmp_path)).select("left").count() > 0 and QUERIES["lap_match"](spark, str(tmp_path)).count() == 71
