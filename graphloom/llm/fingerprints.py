"""Order MinHash of texts: fingerprints whose likeness falls with the edit distance of the words, moved parts included.

A text's k-mers are runs of ``k`` words, numbered by occurrence, so a repeated
one counts as often as it stands there. Each is hashed to a place on a circle.
From each of evenly spaced points of the circle, the next ``most`` k-mers are
the smallest in the order that begins at that point; put back into the order
they have in the text and hashed together, they are one number of the
fingerprint. So one sort of a text's k-mers serves ``points`` orders, each of
which picks all sets of k-mers alike; ``turns`` hash all k-mers anew. Two texts
agree in a number if both pick the same k-mers there and hold them in the same
order.

Only built-in functions: arrays within a row, no row for each k-mer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words are runs without white space, cut after 24 characters; ideographs and kana are words of their own.
_LONE = r"぀-ヿ㐀-鿿"
WORDS = r"[^\x20\x09-\x0D]{1,24}"
WORDS_APART = rf"[{_LONE}]|[^\x20\x09-\x0D{_LONE}]{{1,24}}"
#: Points of a circle (a power of two), circles, k-mers of a number, words of a k-mer.
POINTS, TURNS, MOST, K = 64, 1, 2, 3
#: Ranges of documents for each shuffle partition.
RANGES = 3


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _numbered(grams: Column) -> Column:
    """Sorted ``(h, at)`` with repeated h told apart by how often they came before, sorted again."""
    n = F.size(grams)
    again = lambda i: (i > 0) & (F.get(grams, i)["h"] == F.get(grams, i - 1)["h"])

    def renumber(begins: Column) -> Column:
        ends = F.concat(F.slice(begins, F.lit(2), F.size(begins)), F.array(n))
        counts = F.flatten(F.zip_with(begins, ends, lambda a, b: F.sequence(F.lit(0), b - a - 1)))
        return F.sort_array(F.zip_with(grams, counts, lambda x, c: F.struct(F.when(c == 0, x["h"]).otherwise(F.xxhash64(x["h"], c)).alias("h"), x["at"].alias("at"))))

    repeats = F.exists(F.transform(grams, lambda x, i: again(i)), lambda x: x)
    return F.when(repeats, _let(F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~again(i)), renumber)).otherwise(grams)


def _circle(grams: Column, points: int, most: int) -> Column:
    """One number for each point: of the next ``most`` of sorted ``(h, at)`` from there on, in the order of ``at``."""
    bits = points.bit_length() - 1
    place = lambda x: (F.shiftright(x["h"], 64 - bits) + points // 2).cast("int")
    near = F.filter(grams, lambda x, i: (i < most) | (place(F.get(grams, i - most)) != place(x)))  # what lies further than ``most`` behind each point is next of none

    def numbers(near: Column) -> Column:
        n = F.size(near)

        def number(i: Column) -> Column:
            picked = F.array(*[F.get(near, F.pmod(i + j, n)) for j in range(most)])
            ordered = F.sort_array(F.transform(picked, lambda x: F.struct(x["at"], x["h"])))
            return F.shiftright(F.xxhash64(F.transform(ordered, lambda x: x["h"])), 32).cast("int")

        def of(x: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(-1)).otherwise(place(F.get(near, i - 1)))
            return _let(place(x) - before, lambda times: F.when(times > 0, F.array_repeat(number(i), times)).otherwise(F.array().cast("array<int>")))

        wrapped = F.array_repeat(number(F.lit(0)), F.lit(points - 1) - place(F.get(near, n - 1)))
        return F.concat(F.flatten(F.transform(near, of)), wrapped)

    return _let(near, numbers)


def order_minhash(text: Column, k: int = K, points: int = POINTS, turns: int = TURNS, most: int = MOST) -> Column:
    """The fingerprint of a text as ``points * turns`` numbers.

    A text of fewer than ``k`` words is one k-mer; null or without words, its
    numbers are all 0. Whole texts, whatever their length.
    """

    def of_words(hashes: Column) -> Column:
        grams = F.transform(
            F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (k - 1), F.lit(1))),
            lambda x, i: F.struct(F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, k)]).alias("h"), i.alias("at")),
        )
        return _let(_let(F.sort_array(grams), _numbered), of_grams)

    def rehashed(turn: int) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.xxhash64(x["h"], F.lit(turn)).alias("h"), x["at"].alias("at"))

    def of_grams(grams: Column) -> Column:
        circles = []
        for turn in range(turns):
            anew = grams if not turn else F.sort_array(F.transform(grams, rehashed(turn)))
            circles.append(_let(anew, lambda g: _circle(g, points, most)))
        return F.concat(*circles)

    text = F.coalesce(text, F.lit(""))
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    words = F.when(text.rlike(f"[{_LONE}]"), found(WORDS_APART)).otherwise(found(WORDS))  # alike where there is none; the first pattern takes several times as long
    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return _let(hashes, lambda h: F.when(F.size(h) > 0, of_words(h)).otherwise(F.array_repeat(F.lit(0), points * turns)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal numbers of two fingerprints."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def written(numbers: Column) -> Column:
    """Eight hexadecimal digits for each number."""
    return F.array_join(F.transform(numbers, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def with_next(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, numbers, next_text, next_numbers)``: each document, its fingerprint, and the document after it by falling doc_id; after the last comes the first.

    ``docs (doc_id, text)``, doc_id a whole number; a null text is empty, a
    null doc_id comes last, and rows of one doc_id follow each other by a hash
    of their text, then by text. A single document follows itself; no rows give
    no rows. Other columns are ignored.

    Documents are dealt to ranges of doc_id and hash, so that rows of one
    doc_id, or without any, are several ranges too (rows that are equal in both
    stand in one, read in order). Texts are moved once. Each range also gets a
    copy of the first document of the next one. The driver gets a number for
    each range, and ranges go by the session's shuffle partitions.
    """
    spark = docs.sparkSession
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lowest = docs.agg(F.min("doc_id")).first()[0]
    whole = F.coalesce(F.col("doc_id").cast("double"), F.lit(float(lowest or 0) - 1))
    steps = [(i + 1) / ranges for i in range(ranges - 1)]
    bounds = sorted(set(docs.select((whole + F.rand(1)).alias("at")).agg(F.percentile_approx("at", steps, F.lit(10_000)).alias("b")).first()[0] or []))
    share = F.shiftrightunsigned(F.xxhash64("text"), 11) / float(1 << 53)
    placed = docs.withColumn("share", share).withColumn("at", whole + F.col("share"))
    placed = placed.withColumn("range", F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<double>"), lambda b: b <= F.col("at"))))
    order = [F.desc_nulls_last("doc_id"), F.desc("share"), "text"]
    tops = {r["range"]: r["at"] for r in placed.groupBy("range").agg(F.max("at").alias("at")).collect()}  # a number for each range
    used = sorted(tops)
    above = [(r, tops[r], used[(i + 1) % len(used)]) for i, r in enumerate(used)]
    firsts = placed.join(F.broadcast(spark.createDataFrame(above, "range int, at double, above int")), ["range", "at"])
    firsts = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("range").orderBy(*order))).where("rank = 1")
    columns = ["range", "guard", "doc_id", "share", "text", "numbers"]
    numbers = lambda rows, guard: rows.withColumn("numbers", order_minhash(F.col("text"))).withColumn("guard", F.lit(guard))
    rows = numbers(placed, 0).select(columns).union(numbers(firsts.drop("range").withColumnRenamed("above", "range"), 1).select(columns))
    over = Window.partitionBy("range").orderBy("guard", *order)
    rows = rows.withColumn("next_text", F.lead("text").over(over)).withColumn("next_numbers", F.lead("numbers").over(over))
    return rows.where("guard = 0").select("doc_id", "text", "numbers", "next_text", "next_numbers")


def half_replaced(text: Column, by: Column) -> Column:
    """A text whose last half (rounded down) is replaced by as many first code points of another, or by all of it."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(by, F.lit(1), half))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` of each document, its half-replaced text and the next document; see ``with_next``."""
    rows = with_next(docs).withColumn("edited", half_replaced(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "numbers", "next_numbers", order_minhash(F.col("edited")).alias("edited_numbers"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("numbers")).alias("fingerprint"), written(F.col("edited_numbers")).alias("edited_fingerprint"),
        likeness(F.col("numbers"), F.col("edited_numbers")).alias("near_edited"), likeness(F.col("numbers"), F.col("next_numbers")).alias("near_next"),
    )
