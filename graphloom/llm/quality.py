"""Quality rules as a bitmask ledger, in SQL functions only.

One pass over the text measures a document and evaluates every rule once; the
failures are bits of one number, stored with the measurements. A policy is a
versioned choice of rules, so applying one, or asking what a rule removes on
its own, is bit arithmetic on the ledger and never reads the text again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.durable import cut

_WS = r"[\\x20\\x09-\\x0D]"

#: Rules in order of their bits: name and SQL condition of failure on the measurements.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("no_letters", "10 * n_letter_words < 7 * n_words"),
    ("shouting", "2 * n_upper > n_letters"),
    ("ellipses", "10 * n_ellipsis_lines > 3 * n_lines"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Versioned policies: the rules that a document must not fail.
POLICIES = {
    "base-1": BASE,
    "strict-1": BASE | BIT["word_length"] | BIT["symbols"] | BIT["repeated_lines"] | BIT["no_letters"] | BIT["shouting"] | BIT["ellipses"],
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_letters", "n_upper", "n_ellipsis_lines"]


def _steps(df: DataFrame, *steps: dict[str, str]) -> DataFrame:
    for step in steps:
        df = df.withColumns({k: F.expr(v) for k, v in step.items()})
    return df


def measure(documents: DataFrame, whole: bool = False) -> DataFrame:
    """``doc_id`` and the measurements of each row of ``documents (doc_id, text)``; with ``whole`` also ``row``, a struct of all its columns.

    A null text counts as empty and measures 0 throughout; repeated rows are
    repeated; a null doc_id stays null; other columns are ignored; an empty
    table gives no rows. Texts are measured whole, however long.

    ``n_repeat_words`` counts words inside some three-word window that the text
    has more than once. Windows are compared by 64-bit hashes: 40 bits of the
    hash and the window's place make one number, so that sorting plain numbers
    puts equal windows side by side. Where two neighbours agree in the 40 bits
    but not in all 64, or places need over 24 bits, pairs of full hash and
    place are sorted instead.
    """
    rows = [F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")] if whole else []
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *rows)
    out = _steps(
        docs,
        {"_body": "btrim(text, ' \t\n\x0b\x0c\r')"},
        {"_words": f"CASE WHEN _body = '' THEN array() ELSE split(_body, '{_WS}+') END", "_lines": rf"filter(split(text, '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]')"},
        {
            "n_words": "CAST(size(_words) AS LONG)",
            "word_chars": f"CAST(char_length(regexp_replace(text, '{_WS}+', '')) AS LONG)",
            "n_symbols": "CAST(char_length(regexp_replace(text, '[^#*$%&|<>]+', '')) AS LONG)",
            "n_lines": "CAST(size(_lines) AS LONG)",
            "n_dup_lines": "CAST(size(_lines) - size(array_distinct(_lines)) AS LONG)",
            "n_ellipsis_lines": r"CAST(size(filter(_lines, x -> x RLIKE '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')) AS LONG)",
            "n_letters": r"CAST(char_length(regexp_replace(text, '\\P{L}+', '')) AS LONG)",
            "n_upper": r"CAST(char_length(regexp_replace(text, '[^\\p{Lu}]+', '')) AS LONG)",
            "n_letter_words": r"CAST(size(filter(_words, x -> x RLIKE '\\p{L}')) AS LONG)",
            "_windows": "CASE WHEN size(_words) < 3 THEN array() ELSE transform(sequence(0, size(_words) - 3), i -> xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2))) END",
        },
        {"_again": "size(array_distinct(_windows)) < size(_windows)"},
        {"_keys": f"CASE WHEN _again THEN sort_array(transform(_windows, (h, i) -> (h & {~0xFFFFFF}) | i)) END"},
        {
            "_plain": f"size(_keys) <= {1 << 24} AND NOT exists(sequence(1, size(_keys) - 1), k -> get(_keys, k) & {~0xFFFFFF} = get(_keys, k - 1) & {~0xFFFFFF}"
            f" AND get(_windows, CAST(get(_keys, k) & {0xFFFFFF} AS INT)) <> get(_windows, CAST(get(_keys, k - 1) & {0xFFFFFF} AS INT)))"
        },
        {
            "_pairs": f"CASE WHEN _again AND _plain THEN transform(_keys, x -> struct(x & {~0xFFFFFF} AS h, CAST(x & {0xFFFFFF} AS INT) AS i))"
            " WHEN _again THEN sort_array(transform(_windows, (x, j) -> struct(x AS h, j AS i))) END"
        },
        {"_places": "CASE WHEN _again THEN sort_array(transform(filter(transform(_pairs, (x, k) -> struct(x.h = get(_pairs, k - 1).h OR x.h = get(_pairs, k + 1).h AS hit, x.i AS i)), x -> x.hit), x -> x.i)) END"},
        {"n_repeat_words": "CASE WHEN _again THEN CAST(aggregate(zip_with(_places, slice(_places, 2, size(_places)), (a, b) -> coalesce(least(3, b - a), 3)), 0, (s, x) -> s + x) AS LONG) ELSE 0L END"},
    )
    return out.select("doc_id", *MEASURES, *["row"] * whole)


def _judged(documents: DataFrame, whole: bool = False) -> DataFrame:
    bits = " | ".join(f"CASE WHEN {condition} THEN {BIT[name]}L ELSE 0L END" for name, condition in RULES)
    return measure(documents, whole).withColumn("failed_bits", F.expr(bits))


def ledger(documents: DataFrame) -> DataFrame:
    """The measurements with ``failed_bits``: bit i is set when rule i of ``RULES`` fails.

    The ledger is written to the shared folder, so policies read numbers. It
    also keeps the optimizer from copying the measuring expressions into a
    filter or lambda above, where they would run many times over.
    """
    return cut(_judged(documents))


def apply_policy(book: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``kept``: whether a document fails no rule of the policy."""
    return book.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablations(book: DataFrame) -> DataFrame:
    """Per policy and rule of it: documents failing the rule, failing it alone, and kept without it.

    Bit patterns are counted first, so what is left to do has a row for each pattern.
    """
    patterns = book.groupBy("failed_bits").agg(F.count("*").alias("n"))
    rows = [(policy, name, mask, BIT[name]) for policy, mask in POLICIES.items() for name in BIT if mask & BIT[name]]
    asked = book.sparkSession.createDataFrame(rows, "policy string, rule string, mask long, bit long")
    each = patterns.join(F.broadcast(asked))  # a fixed number of rows
    hit, alone, kept = F.expr("failed_bits & bit != 0"), F.expr("failed_bits & mask = bit"), F.expr("failed_bits & mask & ~bit = 0")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy("policy", "rule").agg(total(hit).alias("n_failed"), total(alone).alias("n_alone"), total(kept).alias("n_kept_without"), F.bit_or("failed_bits").alias("seen_bits"))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the strict policy; the others go.

    Every row stands by its own text, whatever its doc_id, and passes through
    one narrow step: nothing is written or joined. The filter also asks for a
    row number, which it cannot be moved below, so measurements run once.
    """
    rows = _judged(docs, whole=True).withColumn("_nth", F.monotonically_increasing_id())
    kept = apply_policy(rows, "strict-1").where(F.col("kept") & (F.col("_nth") >= 0))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
