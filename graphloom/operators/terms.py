"""Frequencies and probabilities of annotation terms, and inverse document frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.durable import cut


def term_frequency(annotations: DataFrame) -> DataFrame:
    """``(term, n)``: annotated genes of each term in ``annotations (gene, terms)``."""
    return annotations.select("gene", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def closure(edges: DataFrame) -> DataFrame:
    """``(term, reached)`` over directed ``edges (src, dst)``, without the term itself unless it lies on a cycle; each pair once however many paths lead there."""
    steps = cut(edges.select(F.col("src").alias("term"), F.col("dst").alias("reached")).distinct())
    all_, last = steps, steps
    while True:
        onward = last.join(steps.select(F.col("term").alias("reached"), F.col("reached").alias("next")), "reached").select("term", F.col("next").alias("reached")).distinct()
        last = cut(onward.join(all_, ["term", "reached"], "left_anti"))
        if last.isEmpty():
            return all_
        all_ = cut(all_.union(last))


def term_probability(frequency: DataFrame, terms: DataFrame, edges: DataFrame) -> DataFrame:
    """``(term, aspect, probability)`` of annotated terms: counts of the term and all that it reaches, over the largest such sum of its aspect.

    ``terms (name, aspect)``; terms that are not among them are dropped.
    """
    known = frequency.join(terms.select(F.col("name").alias("term"), "aspect"), "term")
    reach = known.select("term", F.col("term").alias("reached")).union(closure(edges).join(known.select("term"), "term", "left_semi")).distinct()
    sums = reach.join(frequency.select(F.col("term").alias("reached"), "n"), "reached").groupBy("term").agg(F.sum("n").alias("total"))
    rows = known.select("term", "aspect").join(sums, "term")
    top = rows.groupBy("aspect").agg(F.max("total").alias("top"))
    return rows.join(top, "aspect").select("term", "aspect", (F.col("total") / F.col("top")).alias("probability"))


def inverse_document_frequency(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(feature, idf)`` over stacked ``(name, features)``: ln(rows / (1 + rows of either side with a positive value))."""
    stacked = left.select("features").union(right.select("features"))
    total = stacked.agg(F.count("*").alias("rows"))  # one row
    hits = stacked.select(F.posexplode("features").alias("feature", "value")).groupBy("feature").agg(F.count(F.when(F.col("value") > 0, 1)).alias("hits"))
    return hits.join(F.broadcast(total)).select("feature", F.ln(F.col("rows") / (1 + F.col("hits"))).alias("idf"))
