"""Packing documents into token sequences by the sum-of-squares rule.

A piece goes where the sum over all gaps g of (open sequences with gap g)^2
becomes least. That keeps gaps of every size in stock, so that later pieces
fill sequences to the end. Pieces are dealt to shards by hash, each small
enough for one task; the waste of a shard is a few open sequences.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.durable import cut
from graphloom.llm import words as w

END_ID = 0
#: Words whose ids a worker remembers, and pieces that one task packs.
REMEMBERED, SHARD = 600_000, 50_000


def parts_words(tokenizer: dict) -> tuple[bool, bool]:
    """Whether a tokenizer file's parts are those for which words can be encoded alone; and whether it ignores case.

    Needed are: a BPE with word ends, a normaliser that composes characters,
    joins white space and may lower, and a split whose pattern takes runs of
    letters apart from points and commas and never spans white space, each
    piece by itself.
    """
    kinds = lambda x: [] if x is None else [k for y in x.get("normalizers") or x.get("pretokenizers") for k in kinds(y)] if x["type"] == "Sequence" else [x]
    model, normal, before = tokenizer["model"], kinds(tokenizer["normalizer"]), kinds(tokenizer["pre_tokenizer"])
    spaces = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in normal)
    splits = [x["pattern"].get("Regex", "") for x in before if x["type"] == "Split"]
    patterns = len(splits) == 1 and r"[\p{L}]+" in splits[0] and r"[^\s\p{L}\p{N}]+" in splits[0] and all(x["type"] in ("Split", "ByteLevel") for x in before)
    whole = model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("ignore_merges")
    return bool(whole and spaces and patterns), any(x["type"] == "Lowercase" for x in normal)


class WordIds:
    """Ids of texts under a BPE tokenizer with word ends that never joins what ASCII white space separates.

    Each distinct word is encoded once and remembered: in lower case where the
    tokenizer ignores case (``lower``), and without a point or comma that
    follows an ASCII letter, as the tokenizer splits there anyway. Words of
    letters are encoded many at a time and told apart by the ids that end one.
    Under a tokenizer of another kind (see ``parts_words``) texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.apart, self.lower = parts_words(json.loads(self.tokenizer.to_str()))
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for x, i in names.items() if x.endswith("</w>")]] = True

    def _learn(self, words: list[str]) -> None:
        plain = [x for x in words if x.isalpha()]
        runs = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        alone = [x for x in words if not x.isalpha()]
        for run, found in zip(runs, self.tokenizer.encode_batch_fast([" ".join(x) for x in runs], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(run):  # something in it that the tokenizer doesn't count as a letter
                alone += run
                continue
            whole, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.known.update((x, whole[at[i] : at[i + 1]]) for i, x in enumerate(run))
        for i in range(0, len(alone), 10_000):
            some = alone[i : i + 10_000]
            self.known.update((x, np.array(e.ids, np.uint32).tobytes()) for x, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and where each text's begin (one more than texts)."""
        if not self.apart:
            ids = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        if self.lower:
            texts = pc.ascii_lower(texts)
        words, codes, at = w.vocabulary(pc.replace_substring_regex(texts, "([A-Za-z])([.,])", r"\1 \2"))
        listed = words.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        self._learn([x for x in listed if x not in known])
        ids = [known[x] for x in listed]
        starts = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) >> 2, out=starts[1:])
        flat, ends = w.gather(np.frombuffer(b"".join(ids), np.uint32), starts, codes)
        return flat, ends[at]


def _pieces(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds(path)
        for batch in batches:
            for part in w.slices(batch, most=4 * w.SLICE_BYTES):
                flat, at = encode(part.column("text"))
                row, start, length, crc = [], [], [], []
                for i in range(len(part)):
                    ids = np.append(flat[at[i] : at[i + 1]], np.uint32(END_ID)).astype("<u4")
                    for s in range(0, len(ids), size):
                        piece = ids[s : s + size]
                        row.append(i), start.append(s), length.append(len(piece)), crc.append(zlib.crc32(piece.tobytes()))
                start = np.array(start, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array((start // size).astype(np.int32)), pa.array(start), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, placed in the order given.

    Moving a sequence from gap g to g - s changes the sum of squares by
    2 (open[g - s] - open[g] + 1), a full sequence counting nothing, and a new
    one by 2 open[size - s] + 1. Ties go to the smallest gap.
    """
    count = np.zeros(size + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(size + 1)]
    where, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        cost = np.where(count[s:] > 0, 2 * (count[: size + 1 - s] - count[s:] + 1), never)
        k = int(cost.argmin())
        fresh = 2 * count[size - s] + 1 if s < size else 0
        if cost[k] == never or fresh < cost[k]:
            number, gap, made = made, size, made + 1
        else:
            gap = s + k
            number = waiting[gap].pop()
            count[gap] -= 1
        where[i], offset[i] = number, size - gap
        if gap > s:
            waiting[gap - s].append(number)
            count[gap - s] += 1
    return where, offset


def _pack(size: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "doc_id", "start"], ascending=[False, True, True])
        where, offset = sum_of_squares(shard["length"].to_numpy(), size)
        shard["sequence_id"] = shard["shard"].to_numpy() * (1 << 32) + where
        return shard.assign(offset=offset).drop(columns="shard")

    return run


def pack(documents: DataFrame, tokenizer: str, size: int = 2048, per_shard: int = SHARD) -> DataFrame:
    """Pieces of all ``documents (doc_id, text)`` and their places in sequences of at most ``size`` tokens.

    A document is its ids by the tokenizer file, then id 0; a null text is
    empty. Only documents of more than ``size`` ids are cut, into pieces of
    ``size``; the last may be shorter. Columns: ``doc_id``, ``piece``, ``start``,
    ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    Repeated rows are packed as often as they occur; a null doc_id stays null;
    other columns are ignored; an empty table gives no rows.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = cut(docs.mapInArrow(_pieces(tokenizer, size), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    shards = max(1, math.ceil(pieces.count() / per_shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(_pack(size), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the tokens of every document go."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
