"""Passages that repeat across documents, by content-defined chunks.

A gear rolling hash over 16 words gives every place a value; of each window of
``min_words`` words the place of the least value is its anchor, and the windows
of one anchor are a chunk. Both depend on the window's own words only, so equal
windows have equal anchors whatever stands around them, and text without any
particular word has anchors too. Chunks equal as a whole point to the first
document with them; where chunks of one anchor differ, their windows are
compared by digest, so a passage finds the first document that holds a whole
window of it. From there the words of both texts are compared outwards, so that
what is reported is the exact common run. White space does not matter to
digests or comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.durable import Scratch, cut, discard
from graphloom.llm import words as w
from graphloom.llm.crowds import crowded, meet

#: Words under the gear hash, a power of two.
GRAM = 16


def chunks(texts: pa.Array, min_words: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every chunk: text, first word in it, words, digest of its anchor, digest of all its words. Chunks overlap; every window of ``min_words`` words is in one."""
    data, offsets = w.raw(texts)
    starts, ends, at = w.spans(data, offsets)
    words = w.word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    window = np.flatnonzero(np.arange(len(words)) + min_words <= at[1:][doc])
    if not len(window):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    gear, step = words, 1
    while 2 * step <= min(GRAM, min_words):  # each doubles the words
        gear = np.concatenate([gear[:-step] + (gear[step:] << np.uint64(step)), gear[len(gear) - step :]])
        step *= 2
    value = w.mix(gear)
    least, at_least, wide, grams = value, np.arange(len(value)), 1, min_words - step + 1
    while wide < grams:  # the first least of so many places from each on
        by = min(wide, grams - wide)
        less = least[by:] < least[:-by]
        least, at_least = np.where(less, least[by:], least[:-by]), np.where(less, at_least[by:], at_least[:-by])
        wide += by
    anchor = at_least[window]
    new = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    begin, end = window[new], window[np.append(new[1:], len(window)) - 1] + min_words
    return doc[begin], begin - at[doc[begin]], end - begin, value[anchor[new]], w.range_hashes(words, begin, end)


def _chunk_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch):
                doc, word, n, digest, whole = chunks(part.column("text"), min_words)
                ids = part.column("doc_id").take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids, pa.array(word.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(digest.view(np.int64)), pa.array(whole.view(np.int64))], ["doc_id", "word", "n", "digest", "whole"])

    return run


def _window_rows(min_words: int):
    """Digests of all windows in the listed chunks of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch):
                data, offsets = w.raw(part.column("text"))
                starts, ends, at = w.spans(data, offsets)
                words, listed = w.word_hashes(data, starts, ends), part.column("chunks")
                fields = listed.flatten()
                doc = np.repeat(np.arange(len(listed)), listed.value_lengths().to_numpy())
                first, n = (fields.field(k).to_numpy().astype(np.int64) for k in ("word", "n"))
                first = first + at[doc]
                has = first + n <= at[doc + 1]
                doc, first, many = doc[has], first[has], n[has] - min_words + 1
                begin = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                doc = np.repeat(doc, many)
                digest = w.range_hashes(words, begin, begin + min_words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array((begin - at[doc]).astype(np.int32)), pa.array(digest.view(np.int64))], ["doc_id", "word", "digest"])

    return run


def common_runs(mine: np.ndarray, theirs: np.ndarray, anchors: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Maximal equal runs through the anchors, equal stretches (start in mine, start in theirs, length); the runs too are such triples.

    A stretch inside a run that is found already gives no other one, or a word
    repeated n times would give n runs.
    """
    done, out, reach = {}, [], 0
    for i, j, long in sorted(anchors):
        if i < done.get(i - j, 0) or i + long <= reach:  # every run begins at an earlier anchor or before it
            continue
        n = min(len(mine) - i, len(theirs) - j)
        apart = np.flatnonzero(mine[i : i + n] != theirs[j : j + n])
        after = int(apart[0]) if len(apart) else n
        m = min(i, j)
        apart = np.flatnonzero(mine[i - m : i][::-1] != theirs[j - m : j][::-1])
        before = int(apart[0]) if len(apart) else m
        done[i - j] = i + max(after, 1)
        reach = max(reach, i + after)
        out.append((i - before, j - before, before + after))
    return out


class _Text:
    """Word hashes and places of one text."""

    def __init__(self, text: str):
        self.data, offsets = w.raw(pa.array([text]))
        self.starts, self.ends, _ = w.spans(self.data, offsets)
        self.words = w.word_hashes(self.data, self.starts, self.ends)

    def chars(self, begin: int, end: int) -> tuple[int, int]:
        """Characters before the run of words [begin, end) and up to its end."""
        lead = (self.data & 0xC0) != 0x80
        a = int(lead[: self.starts[begin]].sum())
        return a, a + int(lead[self.starts[begin] : self.ends[end - 1]].sum())


def _extend(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int | None, _Text | None] = (None, None)
        for batch in batches:
            for part in w.slices(batch):
                out: list[tuple] = []
                for doc, src, anchors, text, source, digest in zip(*(part.column(c).to_pylist() for c in ("doc_id", "src", "anchors", "text", "source", "text_hash")), strict=True):
                    if known[0] != src:  # rows come sorted by source
                        known = (src, _Text(source))
                    mine = _Text(text)
                    for i, j, n in common_runs(mine.words, known[1].words, [(a["word"], a["src_word"], a["n"]) for a in anchors]):
                        if n >= min_words:
                            out.append((doc, i, n, *mine.chars(i, i + n), src, j, digest))
                names = ["doc_id", "word", "n_words", "start", "stop", "source_doc_id", "source_word", "text_hash"]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(8)], names)

    return run


def _one_text(docs: DataFrame) -> DataFrame:
    """Without the rows of a doc_id whose text is not that of its least hash."""
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    several = cut(hashed.groupBy("doc_id").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi")).where("lo <> hi").select("doc_id", "lo"))
    if several.isEmpty():
        discard(several)
        return docs
    return hashed.join(several, "doc_id", "left").where("lo IS NULL OR text_hash = lo").select("doc_id", "text")


def repeated_passages(documents: DataFrame, min_words: int = 50) -> DataFrame:
    """Passages of ``documents (doc_id, text)`` that a document of smaller doc_id also has.

    A row for each passage: ``doc_id``, ``word`` (its first word), ``n_words``,
    ``start`` and ``stop`` (characters), ``source_doc_id``, ``source_word``,
    and ``text_hash`` (``xxhash64`` of the text that it is in).
    Every word in a run of ``min_words`` words that a smaller doc_id has is in
    a passage. Passages of one document may overlap.

    Null and wordless texts, and rows with a null doc_id, have no passages.
    Repeated rows of one doc_id count as one document; of different texts of
    one doc_id that of the least hash takes part. The source is the smallest
    doc_id with the same chunk, or else with the same window, at the first
    place in it. Texts are taken whole; a very long one is worked on by one
    task, which holds its words' hashes. Other columns are ignored; an empty
    table gives no rows.
    """
    docs = _one_text(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL"))
    rows = cut(docs.mapInArrow(_chunk_rows(min_words), "doc_id long, word int, n int, digest long, whole long"))
    # most anchors are in one document only, and their chunks go before anything else is grouped or joined
    met = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("digest"))
    shared = cut(rows.join(met, "digest", "left_semi"))
    discard(rows, met)
    rows = shared
    place = F.min(F.struct("doc_id", "word")).alias("first")
    wholes = rows.groupBy("digest", "whole").agg(place, F.max("doc_id").alias("last"))
    unlike = wholes.groupBy("digest").agg(F.count("*").alias("k"), F.min("first.doc_id").alias("low"), F.max("last").alias("high")).where("k > 1 AND low < high").select("digest", F.lit(True).alias("unlike"))
    marked = wholes.join(unlike, "digest", "left").where("unlike OR first.doc_id < last").select("digest", "whole", "unlike", F.col("first.doc_id").alias("src"), F.col("first.word").alias("src_word"))
    found = cut(rows.join(marked, ["digest", "whole"]).where("doc_id > src OR unlike").select("doc_id", "word", "n", "src", "src_word"))
    same = found.where("doc_id > src").select("doc_id", "src", "word", "src_word", "n")
    # a chunk no smaller doc_id has as a whole may still have windows in common
    open_ = found.where("doc_id = src").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("word", "n"))).alias("chunks"))  # no more than a document's chunks
    windows = cut(docs.join(open_, "doc_id").mapInArrow(_window_rows(min_words), "doc_id long, word int, digest long"))
    first = windows.groupBy("digest").agg(place, F.max("doc_id").alias("last")).where("first.doc_id < last")
    part = windows.join(first.select("digest", F.col("first.doc_id").alias("src"), F.col("first.word").alias("src_word")), "digest").where("doc_id > src").select("doc_id", "src", "word", "src_word", F.lit(min_words).alias("n"))
    anchors = cut(same.union(part).groupBy("doc_id", "src").agg(F.collect_list(F.struct("word", "src_word", "n")).alias("anchors")))
    discard(rows, found, windows)
    ids = anchors.select("doc_id").union(anchors.select("src")).distinct()
    texts = cut(docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]))  # so that what dealt out all texts is gone before these few are joined
    # a text that thousands of others take from, or that takes from thousands, meets them in many tasks
    mine = meet(anchors, texts, "doc_id", "src", crowded(anchors, "doc_id"))
    both = meet(mine, texts.select(F.col("doc_id").alias("src"), F.col("text").alias("source")), "src", "doc_id", crowded(anchors, "src"))
    return both.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_extend(min_words), "doc_id long, word long, n_words long, start long, stop long, source_doc_id long, source_word long, text_hash long").distinct()


def cut_passages(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """``documents`` without the characters of their passages; ``n_chars`` follows the text where there is such a column.

    A row without passages stays as it is, as does one whose text is not the
    one that the passages of its doc_id are in. Columns may have any names.
    """
    key = ["doc_id", "text_hash"]
    spans = passages.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))  # a document's own passages
    left = F.expr(
        "aggregate(spans, named_struct('at', 0L, 'out', ''), (s, x) -> named_struct('at', greatest(s.at, x.stop), 'out',"
        " CASE WHEN x.start > s.at THEN concat(s.out, substring(row.text, CAST(s.at + 1 AS INT), CAST(x.start - s.at AS INT))) ELSE s.out END),"
        " s -> concat(s.out, substring(row.text, CAST(s.at + 1 AS INT))))"
    )
    names = documents.columns
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    out = rows.join(spans, key, "left").select("row", "spans", F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(left).alias("left"))
    changed = {"text": F.col("left")}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.char_length("left")).cast(documents.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])


def substring_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that an earlier document has; those left without a word go."""
    with Scratch() as s:  # of its tables only the passages stay
        passages = s.keep(cut(repeated_passages(docs)))
    return cut_passages(docs, passages).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
