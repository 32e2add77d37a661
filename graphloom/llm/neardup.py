"""Near-duplicate classes by one-permutation MinHash, bands and star-shaped candidates.

1. A document's set is its distinct word shingles, as 64-bit hashes. One pass
   of one hash per shingle gives the signature: the hash range is cut into bins
   and each bin keeps its least hash; an empty bin borrows from a full one
   picked by a fixed random order of its own (optimal densification).
2. Documents with equal sets are one class; only classes go on.
3. Signature bands make buckets. In each bucket every class is paired with one
   centre only (a star), so a bucket of m classes costs m - 1 pairs. Pairs are
   confirmed on full sets; confirmed pairs make components.
4. Buckets that still hold several components get further stars with other
   centres, to members of other components than the centre's. Buckets of one
   component are done, as components only grow.
5. What stars can miss is a link between two classes of a bucket that are still
   in different components. Here the members outside a bucket's commonest
   component meet the bucket, in blocks, with a bitmap of each set: marks that
   only one of two sets has bound their similarity from above. What the bound
   leaves is confirmed on full sets too. So no cap drops a pair.

With 32 bands of 5 bins, a pair of similarity 0.85 shares no band with
probability (1 - 0.85^5)^32, about 7e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.durable import Scratch, cut, discard
from graphloom.llm import words as w
from graphloom.llm.crowds import crowded, meet
from graphloom.operators.components import joined_components

BANDS, ROWS = 32, 5
#: Members of a bucket that one task compares with the bucket's outliers.
BLOCK = 20_000


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and each text's offset among them.

    Letters A-Z count as a-z. A text of fewer words than ``width`` is one
    shingle; a text without words has none.
    """
    data, offsets = w.raw(texts)
    starts, ends, at = w.spans(data, offsets)
    word = w.word_hashes(data, starts, ends, lower=True)
    out, sizes = [], np.zeros(len(at), np.int64)
    for i in range(len(at) - 1):
        own = word[at[i] : at[i + 1]]
        if not len(own):
            continue
        n = max(1, len(own) - width + 1)
        h = np.full(n, min(width, len(own)), np.uint64)
        for k in range(min(width, len(own))):
            h = w.mix(h ^ own[k : k + n], k)
        out.append(np.unique(h))
        sizes[i + 1] = len(out[-1])
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.cumsum(sizes)


def _orders(bins: int) -> np.ndarray:
    """For every bin, the order in which it looks for a full bin to borrow from."""
    key = w.mix(np.arange(bins * bins, dtype=np.uint64), 77).reshape(bins, bins)
    return np.argsort(key, axis=1)


def signatures(hashes: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """One row of ``bins`` values for each non-empty set (empty sets: zeros)."""
    rows = len(offsets) - 1
    doc = np.repeat(np.arange(rows), np.diff(offsets))
    slot = doc * bins + ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]  # hashes are sorted, so a bin's first is its least
    value, full = np.zeros(rows * bins, np.uint64), np.zeros(rows * bins, bool)
    value[slot[first]], full[slot[first]] = hashes[first], True
    order, filled = _orders(bins), full.copy()
    todo = np.flatnonzero(~full & np.repeat(np.diff(offsets) > 0, bins))
    for k in range(bins):
        if not len(todo):
            break
        row = todo - todo % bins
        lender = row + order[todo % bins, k]
        found = full[lender]
        value[todo[found]] = w.mix(value[lender[found]], 1)
        filled[todo[found]] = True
        todo = todo[~found]
    return value.reshape(rows, bins)


def _fingerprints(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch):
                hashes, at = shingle_sets(part.column("text"), width)
                sizes = np.diff(at)
                sign = signatures(hashes, at, bands * rows)
                band = np.zeros((len(sizes), bands), np.uint64)
                for k in range(rows):
                    band = w.mix(band ^ sign[:, k::rows], k)
                band = w.mix(band ^ np.arange(bands, dtype=np.uint64))
                sums = []
                for salt in (11, 12):
                    total = np.zeros(len(hashes) + 1, np.uint64)
                    np.cumsum(w.mix(hashes, salt), out=total[1:])
                    sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * bands), pa.array(band.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(sums[0]), pa.array(sums[1]), lists], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return run


def marks(hashes: np.ndarray) -> np.ndarray:
    """A bitmap of a set: at least 4 bits a member, in words of 64; a bit is the hash's first binary digits."""
    words = 1 << max(1, int(len(hashes) / 16 - 1e-9).bit_length())
    bits = np.zeros(64 * words, bool)
    bits[(hashes >> np.uint64(64 - 6 - (words.bit_length() - 1))).astype(np.int64)] = True
    return np.packbits(bits).view(">i8").astype(np.int64)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda parts: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)), pa.array(np.concatenate(parts)))
        for batch in batches:
            for part in w.slices(batch):
                hashes, at = shingle_sets(part.column("text"), width)
                own = [marks(hashes[at[i] : at[i + 1]]) for i in range(len(part))]
                halves = [np.packbits(np.unpackbits(x.astype(">i8").view(np.uint8)).reshape(-1, 2).any(axis=1)).view(">i8").astype(np.int64) for x in own]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64))), lists(own), lists(halves)], ["doc_id", "shingles", "marks", "halves"])

    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those ``pairs (a, b)`` whose full sets ``(doc_id, shingles)`` are similar enough; a star's centre meets its members in many tasks."""
    left, right = (sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    crowds = {k: crowded(pairs, k) for k in "ab"}
    held = meet(meet(pairs, right, "b", "a", crowds["b"]), left, "a", "b", crowds["a"]).select("a", "b", shared.alias("n"), (F.size("set_a") + F.size("set_b")).alias("both"))
    return held.where(F.lit(100 + percent) * F.col("n") >= F.lit(percent) * F.col("both")).select("a", "b").distinct()


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, turns: int = 2) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``documents (doc_id, text)``.

    Two documents are linked when ``100 * |A and B| >= percent * |A or B|`` on
    their sets of ``width``-word shingles. ``component_id`` is the least doc_id
    reachable over links, ``kept`` says whether it is the row's own.

    Null or wordless texts have an empty set and are linked with nothing. Rows
    with a null doc_id are linked with nothing; their component_id is null and
    they are kept. A repeated row is repeated in the result. Rows of one doc_id
    with different texts are one document with the links of all its texts.
    Texts are taken whole, however long. Other columns are ignored. An empty
    table gives an empty result.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
    key = ["set_a", "set_b", "n_shingles"]
    with Scratch() as s:
        prints = s.keep(cut(docs.mapInArrow(_fingerprints(width, bands, rows), schema)))
        known = prints.where("n_shingles > 0 AND doc_id IS NOT NULL")
        classes = s.keep(cut(known.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"))))  # equal sets have equal bands
        members = classes.select(F.col("rep").alias("doc_id"), F.col("n_shingles").alias("size"), F.explode("bands").alias("bucket"))
        company = members.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket")
        open_ = cut(members.join(company, "bucket").withColumn("component", F.col("doc_id")))
        ids = cut(open_.select("doc_id").distinct())
        sets = cut(docs.join(ids, "doc_id", "left_semi").distinct().mapInArrow(_sets(width), "doc_id long, shingles array<long>, marks array<long>, halves array<long>"))
        links = _texts_of_one(known, classes, key)
        parts = cut(joined_components(links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0), links))
        tested = links.limit(0)
        for turn in range(turns):
            with Scratch() as t:
                pairs = t.keep(cut(_stars(open_, percent, turn).join(tested, ["a", "b"], "left_anti")))
                if pairs.isEmpty():
                    break
                grown = t.keep(cut(joined_components(parts, confirm(pairs, sets, percent))))
                rest = t.keep(_mixed(open_, grown))
            discard(parts, open_)
            tested, parts, open_ = tested.union(pairs), grown, rest
        if not open_.isEmpty():
            parts = cut(joined_components(parts, _across(open_, sets, percent)))
        s.keep(parts)
    named = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    lone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    out = prints.drop("bands").join(named, key, "left")
    out = out.withColumn("component_id", F.when(lone, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _texts_of_one(known: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """``(a, b)``: documents with several texts, and the representatives of their classes."""
    own = F.struct(*key)
    several = known.groupBy("doc_id").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo <> hi").select("doc_id")
    return cut(known.join(several, "doc_id", "left_semi").join(classes.drop("bands"), key).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct())


def _near(x: str, y: str, percent: int) -> Column:
    """Sizes of sets that can be similar enough."""
    return (F.col(x) * percent <= F.col(y) * 100) & (F.col(y) * percent <= F.col(x) * 100)


def _mixed(open_: DataFrame, parts: DataFrame) -> DataFrame:
    """``(bucket, doc_id, size, component)`` of those buckets that still hold several components."""
    known = open_.drop("component").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    known = cut(known.select("bucket", "doc_id", "size", F.coalesce("component", "doc_id").alias("component")))
    mixed = known.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    out = cut(known.join(mixed, "bucket"))
    discard(known)
    return out


def _stars(mixed: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs of each bucket's centre with the members of other components; the centre is the least by doc_id at first, by a hash in later turns."""
    order = F.col("doc_id") if turn == 0 else F.xxhash64("doc_id", F.lit(turn))
    centre = mixed.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), F.col("doc_id").alias("x"), F.col("size").alias("size_x"), F.col("component").alias("of_x"))).alias("c")).select("bucket", "c.*")
    held = mixed.join(centre, "bucket").where("component <> of_x").where(_near("size", "size_x", percent))
    return held.select(F.least("x", "doc_id").alias("a"), F.greatest("x", "doc_id").alias("b")).distinct()


def _lacking(x: str, y: str) -> Column:
    """Marks of set x that set y has not: at least so many members of x are not in y."""
    fit = lambda a, b: F.when(F.size(f"marks{a}") > F.size(f"marks{b}"), F.col(f"halves{a}")).otherwise(F.col(f"marks{a}"))
    bits = F.aggregate(F.zip_with(fit(x, y), fit(y, x), lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, n: s + n)
    return F.coalesce(bits, F.lit(0))  # bitmaps that don't fit bound nothing


def _across(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components: of members outside a bucket's commonest component with the whole bucket.

    With u members of x that y lacks, and v of y that x lacks, at most
    n_x - u are shared, of n_x + v in all. Sets of sizes that can be similar
    enough have bitmaps of one length, or one twice the other, which is
    halved then. A bucket's members are dealt into blocks, which all outliers
    of the bucket meet, so a large bucket is many tasks.
    """
    counts = cut(mixed.groupBy("bucket", "component").agg(F.count("*").alias("n")))
    main = counts.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    held = mixed.join(main, "bucket").join(sets.select("doc_id", "marks", "halves").distinct(), "doc_id")
    held = cut(held.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))))
    minor = held.where("component <> main").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    minor = cut(minor.select(F.col("bucket").alias("own"), F.col("block").alias("with"), *[F.col(c).alias(f"{c}_x") for c in ("doc_id", "size", "component", "marks", "halves")]))
    shared, every = F.col("size_x") - _lacking("_x", ""), F.col("size_x") + _lacking("", "_x")
    close = (F.col("component") != F.col("component_x")) & _near("size", "size_x", percent) & (F.lit(100) * shared >= F.lit(percent) * every)
    met = minor.join(held.drop("main", "blocks"), (F.col("own") == F.col("bucket")) & (F.col("with") == F.col("block")) & close)
    return confirm(cut(met.select(F.least("doc_id_x", "doc_id").alias("a"), F.greatest("doc_id_x", "doc_id").alias("b")).distinct()), sets, percent)


def neardup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more.

    Of repeated rows of a kept doc_id one stays, the least by its text; rows
    with a null doc_id all stay.
    """
    with Scratch() as s:  # of its tables only the ids stay
        kept = s.keep(cut(near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()))
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").select(docs.columns)
    repeated = cut(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if not repeated.isEmpty():
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = named.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.coalesce("text", F.lit(""))).alias("row"))
        named = named.join(repeated, "doc_id", "left_anti").select(docs.columns).union(one.select(*[F.col(f"row.`{c}`") for c in docs.columns]))
    return named.union(docs.where("doc_id IS NULL"))
