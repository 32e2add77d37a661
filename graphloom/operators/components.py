"""Connected components by alternating large-star and small-star steps.

Each step is joins and ``min`` aggregates, so a vertex with a third of all
edges is pre-aggregated before the shuffle and never gathered into one task.
The number of steps grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.durable import Scratch, cut, discard


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` of every endpoint; the component is named by its least node.

    Rows with a null endpoint are ignored; a self-loop gives a component of one
    node; duplicate edges count once; no edges give no rows.
    """
    with Scratch() as whole:
        pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL").distinct()
        pairs = cut(pairs)
        nodes = whole.keep(cut(pairs.select("u").union(pairs.select(F.col("v").alias("u"))).distinct()))
        # u is the larger end, v the smaller
        links = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        seen = _print(links)
        while seen[0]:
            after = cut(_small_star(_large_star(links)))
            discard(links)
            links, now = after, _print(after)
            if now == seen:
                break
            seen = now
        whole.keep(links)
    roots = links.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.join(roots, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))


def joined_components(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, component)`` of known ``parts`` after further ``links (a, b)``.

    Only the links between known components are looked at, so the work goes
    with them and not with what is settled. Nodes without a part are their
    own, and have no row if no link ties them to others.
    """
    of = lambda c, out: parts.select(F.col("node").alias(c), F.col("component").alias(out))
    named = links.select("a", "b").join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left")
    named = cut(named.select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")))
    if named.where("x <> y").isEmpty():
        return parts.select("node", "component")
    merged = connected_components(named.where("x <> y"), "x", "y").select(F.col("node").alias("component"), F.col("component").alias("now"))
    ends = F.array(*(F.struct(F.col(n).alias("node"), F.col(c).alias("component")) for n, c in ("ax", "by")))
    every = parts.select("node", "component").union(named.select(F.explode(ends).alias("p")).select("p.*")).distinct()
    return every.join(merged, "component", "left").select("node", F.coalesce("now", "component").alias("component"))


def _print(links: DataFrame) -> tuple:
    """Row count and order-free hash of the edges: equal when a round changed nothing."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour larger than u moves to the least node around u."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """u and its smaller neighbours all move to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
