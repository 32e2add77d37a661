"""URL filters: host and path rules, and reputation spread over the link graph.

Rules decide the pages they fit. Hosts whose pages are mostly allowed by rules
are seeds of trust, hosts whose pages are mostly blocked are seeds of distrust.
Personalised PageRank carries trust along links between hosts, and distrust
against them: who links to blocked hosts is suspect. A host with more distrust
than trust is blocked where no rule speaks. SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.durable import cut, discard

#: Fixed rules of the query: host, start of the path, verdict.
QUERY_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"'<>]*)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``(suffix, start, verdict, rule)`` from (host, path start, verdict)."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({quoted(h)}, {quoted(p)}, {quoted(v)}, {quoted(h + p)})" for h, p, v in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(suffix, start, verdict, rule)")


def _suffixes(host: Column) -> Column:
    """The host and every domain above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _links(pages: DataFrame) -> DataFrame:
    """``(src, dst, weight)``: links between different hosts, counted; the html of every page is read whole."""
    targets = F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))
    linked = pages.select("host", F.explode(targets).alias("to")).withColumn("to", F.regexp_replace("to", r"^//", "://"))
    dst, _ = split_url(F.col("to"))
    linked = linked.select(F.col("host").alias("src"), dst.alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    return linked.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, every: int = 4) -> DataFrame:
    """Personalised PageRank of ``edges (kind, src, dst, weight)`` from ``seeds (kind, host, seed)``, each kind by itself.

    ``rank = (1 - damping) * seed + damping * sum over links in``, with seeds of
    a kind scaled to sum 1 and a host's rank split over its links by weight.
    Rounds go on until ``every`` of them move less than ``tolerance`` of rank in
    all; lineage is cut then. The change shrinks by ``damping`` each round, so
    they end. Hosts without rank have no row.
    """
    total = seeds.groupBy("kind").agg(F.sum("seed").alias("total"))
    start = cut(seeds.join(total, "kind").where("total > 0").select("kind", "host", (F.col("seed") / F.col("total")).alias("seed")))
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    shares = cut(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    rank = start.withColumnRenamed("seed", "rank")
    if shares.isEmpty():
        return rank.withColumn("rank", F.col("rank") * (1 - damping))
    base = start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"))
    held = None
    while True:
        before = rank
        for _ in range(every):
            sent = shares.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
            rank = base.union(sent).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        rank = cut(rank)
        moved = rank.join(before.withColumnRenamed("rank", "was"), ["kind", "host"], "full_outer").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0]
        discard(held)
        held = rank
        if (moved or 0.0) < tolerance:
            return rank


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, threshold: float = 1.0) -> DataFrame:
    """``(page_id, host, path, rule, verdict, host_trust, host_distrust)`` of every row of ``pages (page_id, url, html)``.

    ``rule`` is the longest that fits (its host is the page's or a domain above
    it, and the path starts with the rule's; of equal length the first by
    text), else null. ``verdict`` is the rule's, else ``block`` where the host's
    distrust is over ``threshold`` times its trust, else ``allow``. ``edges
    (src, dst, weight)`` replaces the links in the html.

    A null url has empty host and path; a null html has no links. Repeated rows
    are repeated; other columns are ignored; an empty table gives no rows.
    Pages are read whole, however long.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    hosts = rows.select("host").distinct()
    known = hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("suffix")).join(rules, "suffix")
    fits = known.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.length("rule")).alias("n"), "rule", "start", "verdict"))).alias("rules"))  # no more than there are rules
    rows = rows.drop("html").join(fits, "host", "left").withColumn("hit", F.get(F.filter("rules", lambda r: F.col("path").startswith(r["start"])), F.lit(0)))
    rows = cut(rows.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("ruled")))
    counts = rows.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("good"), F.count(F.when(F.col("ruled") == "block", 1)).alias("bad"))
    seeds = counts.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("good").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("bad").alias("seed")))).alias("s"), "n")
    seeds = seeds.where(F.col("s.seed") * 2 > F.col("n")).select("s.kind", "host", F.lit(1.0).alias("seed"))
    if edges is None:
        edges = _links(pages.select(host.alias("host"), "html"))
    edges = cut(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    rank = spread(both, seeds)
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    ranks = rank.groupBy("host").agg(part("trust").alias("host_trust"), part("distrust").alias("host_distrust"))
    out = rows.join(ranks, "host", "left").na.fill(0.0, ["host_trust", "host_distrust"])
    own = F.when(F.col("host_distrust") > F.col("host_trust") * threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "host_trust", "host_distrust")
