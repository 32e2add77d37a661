"""Language identification of mixed-language text.

Fitting counts byte n-grams (1 to 5) of lower-cased words per language in
Spark, hashed into a fixed number of buckets, so that the model's size depends
on the languages only. Prediction scores each distinct word of a slice of texts
once: the ranges of its script narrow the languages that may claim it, and the
rest compare n-gram log-likelihoods. A Viterbi pass with a penalty for every
switch labels the words; runs of one label are the spans, and the language
with most letters is the document's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import words as w

UNDETERMINED = "und"
ORDERS, BUCKETS = 5, 1 << 16
#: Scripts by ranges of code points, as character classes.
SCRIPTS = {
    "latin": r"[A-Za-z\x{AA}\x{BA}\x{C0}-\x{24F}\x{1E00}-\x{1EFF}]",
    "greek": r"[\x{370}-\x{3FF}\x{1F00}-\x{1FFF}]",
    "cyrillic": r"[\x{400}-\x{52F}]",
    "hebrew": r"[\x{590}-\x{5FF}]",
    "arabic": r"[\x{600}-\x{6FF}\x{750}-\x{77F}]",
    "devanagari": r"[\x{900}-\x{97F}]",
    "thai": r"[\x{E00}-\x{E7F}]",
    "kana": r"[\x{3040}-\x{30FF}]",
    "han": r"[\x{3400}-\x{9FFF}]",
    "hangul": r"[\x{1100}-\x{11FF}\x{AC00}-\x{D7AF}]",
}
_OTHER = len(SCRIPTS)
#: Bytes that separate letters: ASCII but a-z and A-Z.
_MARK = np.arange(256)
_MARK[[b for b in range(128) if not chr(b).isalpha()]] = 32


@dataclass
class LanguageModel:
    """``weights`` (bucket, language): log-likelihoods; ``allowed`` (script, language): who uses which script."""

    languages: list[str]
    weights: np.ndarray
    allowed: np.ndarray


def _features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of the words, by order (order, byte), and where each word's bytes start (one more than words)."""
    data, at = w.raw(pc.utf8_lower(words))
    sizes = np.diff(at) + 2
    starts = np.concatenate([[0], np.cumsum(sizes)])
    padded = np.full(starts[-1], 32, np.uint64)
    padded[np.arange(len(data)) + np.repeat(np.arange(len(words)) * 2 + 1, np.diff(at))] = _MARK[data]
    out = np.empty((ORDERS, len(padded)), np.int64)
    rolled = np.zeros(len(padded), np.uint64)
    for n in range(ORDERS):  # the n-gram that starts at each byte; one past the word's end falls on its neighbour's first byte, a blank
        rolled = rolled * np.uint64(257)
        rolled[: max(0, len(padded) - n)] += padded[n:]
        out[n] = (w.mix(rolled, n) % np.uint64(BUCKETS)).astype(np.int64)
    inside = np.arange(len(padded)) - np.repeat(starts[:-1], sizes)
    for n in range(1, ORDERS):
        out[n][inside + n >= np.repeat(sizes, sizes)] = -1  # would leave the word
    return out, starts


def _scripts(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The script of each word, and whether it has a letter at all."""
    letters = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False)
    script = np.full(len(words), _OTHER)
    for i, (_, letter) in reversed(list(enumerate(SCRIPTS.items()))):
        if i:
            script[pc.match_substring_regex(words, letter).to_numpy(zero_copy_only=False)] = i
        else:
            script[(script == _OTHER) & pc.match_substring_regex(words, letter).to_numpy(zero_copy_only=False)] = i
    return script, letters


def _count(index: dict[str, int]):
    """Per batch of (text, lang): how often each language has each bucket, and letters' scripts past the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = BUCKETS + _OTHER + 1
        total = np.zeros(len(index) * width, np.int64)
        for batch in batches:
            for part in w.slices(batch):
                words, codes, at = w.vocabulary(part.column("text"))
                if not len(codes):
                    continue
                lang = np.array([index[x] for x in part.column("lang").to_pylist()])
                script, letters = _scripts(words)
                grams, starts = _features(words)
                pair, n = np.unique(codes.astype(np.int64) * len(index) + np.repeat(lang, np.diff(at)), return_counts=True)
                word, lang = pair // len(index), pair % len(index)
                keep = letters[word]
                word, lang, n = word[keep], lang[keep], n[keep]
                total += np.bincount(lang * width + BUCKETS + script[word], weights=n, minlength=len(total)).astype(np.int64)
                for row in grams:
                    flat, ends = w.gather(row, starts, word)
                    owner = np.repeat(np.arange(len(word)), np.diff(ends))
                    real = flat >= 0
                    total += np.bincount(lang[owner[real]] * width + flat[real], weights=n[owner[real]], minlength=len(total)).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])

    return run


def fit(labelled: DataFrame, per_language: int = 3000) -> LanguageModel:
    """A model of the languages in ``labelled (doc_id, text, lang)``.

    ``per_language`` bounds the sample: of a language with more documents, a
    share that gives about so many is taken by a hash of doc_id. Rows with a
    null text or lang don't count. No rows give a model without languages.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros((_OTHER + 1, 0), bool))
    index = {x: i for i, x in enumerate(languages)}
    share = F.create_map(*[F.lit(v) for x in languages for v in (x, min(1.0, per_language / sizes[x]))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).select("text", "lang")
    counted = sample.mapInArrow(_count(index), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    width = BUCKETS + _OTHER + 1
    total = np.zeros(len(languages) * width)
    got = counted.toPandas()  # at most languages * (buckets + scripts) rows
    total[got["slot"]] = got["n"]
    total = total.reshape(len(languages), width).T
    grams, scripts = total[:BUCKETS] + 0.3, total[BUCKETS:]
    weights = np.log(grams / grams.sum(axis=0))
    allowed = scripts > 0.01 * np.maximum(1, scripts.sum(axis=0))
    return LanguageModel(languages, weights.astype(np.float32), allowed)


def _emissions(words: pa.Array, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Score of every word for every language (zeros: no opinion), and whether it has a letter."""
    script, letters = _scripts(words)
    score = np.zeros((len(words), len(model.languages)), np.float32)
    if len(words):
        grams, starts = _features(words)
        padded = np.vstack([model.weights, np.zeros((1, len(model.languages)), np.float32)])  # -1 is the row of zeros
        for row in grams:
            score += np.add.reduceat(padded[row], starts[:-1], axis=0)
        score /= ORDERS
        may = model.allowed[script]
        score[~may & may.any(axis=1, keepdims=True)] -= 50
    score[~letters] = 0
    return score - score.max(axis=1, keepdims=True, initial=-np.inf) if score.size else score, letters


def viterbi(score: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every row of ``score``, where each change of label inside a sequence costs ``penalty``.

    Runs over all sequences at once, a step for each position.
    """
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = offsets[:-1][order], sizes[order]
    back = np.empty(score.shape, np.int8 if score.shape[1] < 128 else np.int32)
    own = np.arange(score.shape[1], dtype=back.dtype)
    labels = np.zeros(len(score), back.dtype)
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), "left")  # sequences longer than t
    last = np.zeros((len(sizes), score.shape[1]), np.float32)
    for t in range(longest):
        k = live[t]
        at = starts[:k] + t
        if t:
            best = last[:k].argmax(axis=1)
            jump = last[np.arange(k), best] - penalty
            stay = last[:k] >= jump[:, None]
            back[at] = np.where(stay, own, best[:, None])
            last[:k] = np.maximum(last[:k], jump[:, None]) + score[at]
        else:
            last[:k] = score[at]
    now = last.argmax(axis=1).astype(back.dtype)
    for t in range(longest - 1, -1, -1):
        k = live[t]
        at = starts[:k] + t
        labels[at] = now[:k]
        if t:
            now[:k] = back[at, now[:k]]
    return labels


def _labelled(part: pa.RecordBatch, model: LanguageModel, penalty: float) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Language, share of letters in it, and spans of each text."""
    names = pa.array([*model.languages, UNDETERMINED])
    n = len(model.languages)
    words, codes, at = w.vocabulary(part.column("text"))
    score, letters = _emissions(words, model)
    weight = np.where(letters, pc.utf8_length(pc.replace_substring_regex(words, r"[^\pL]+", "")).to_numpy(zero_copy_only=False), 0)[codes].astype(float)
    labels = viterbi(score[codes], at, penalty) if n else np.zeros(len(codes), np.int8)
    doc = np.repeat(np.arange(len(part)), np.diff(at))
    share = np.bincount(doc * max(n, 1) + labels, weights=weight, minlength=len(part) * max(n, 1)).reshape(len(part), max(n, 1))
    total = share.sum(axis=1)
    best = np.where((total > 0) & (n > 0), share.argmax(axis=1), n)
    sure = np.where(best < n, share.max(axis=1) / np.maximum(total, 1), 0.0)
    change = np.ones(len(codes), bool)
    change[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(change) if n else np.zeros(0, np.int64)
    length = np.diff(np.append(begin, len(codes))) if len(begin) else begin
    first = begin - at[doc[begin]]
    each = pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(length, pa.int64()), names.take(pa.array(labels[begin]))], ["start", "n_words", "lang"])
    return names.take(pa.array(best)), sure, pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, at).astype(np.int32)), each)


def _predict(model: LanguageModel, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, most=2 * w.SLICE_BYTES):
                lang, sure, spans = _labelled(part, model, penalty)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lang, pa.array(sure), spans], ["doc_id", "lang_pred", "score", "spans"])

    return run


def _accepted(model: LanguageModel, penalty: float, least: float):
    """The rows whose text is in a known language with a score of ``least``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, most=2 * w.SLICE_BYTES):
                lang, sure, _ = _labelled(part, model, penalty)
                yield part.filter(pa.array((sure >= least) & pc.not_equal(lang, UNDETERMINED).to_numpy(zero_copy_only=False)))

    return run


def identify(documents: DataFrame, model: LanguageModel, penalty: float = 6.0) -> DataFrame:
    """``(doc_id, lang_pred, score, spans)`` for every row of ``documents (doc_id, text)``.

    ``spans`` lists runs of words of one language (first word, words, language);
    ``score`` is the share of letters in spans of ``lang_pred``. A null text, or
    one without a letter, is ``und`` with score 0, as is every text when the
    model has no languages. Ties go to the language that sorts first. Other
    columns are ignored; repeated rows are repeated; a null doc_id stays null;
    an empty table gives no rows. Texts are taken whole: one text is never
    split, and takes a step of numpy for each of its words.
    """
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _predict(model, penalty), "doc_id long, lang_pred string, score double, spans array<struct<start: long, n_words: long, lang: string>>"
    )


def training_part(documents: DataFrame) -> DataFrame:
    """The documents that a model may learn from: labelled, and not held out."""
    return documents.where(~held_out()).where("lang IS NOT NULL")


def held_out():
    """Whether a document is held out: crc32 of its doc_id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def language_stage(spark, docs: DataFrame, sf_dir: str, penalty: float = 6.0, least: float = 0.5) -> DataFrame:
    """Documents whose text is mostly in one known language; the others go.

    Every row stands by its own text, whatever its doc_id; a row passes through
    one narrow step with all its columns.
    """
    model = fit(training_part(docs))
    return docs.mapInArrow(_accepted(model, penalty, least), docs.schema)
