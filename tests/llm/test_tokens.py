"""Tokenizers against the libraries on whole texts, and packing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from graphloom.llm import packing, pieces
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
BPE, MODEL = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "   ", "a", " a", "a ", "  a  b   ", "a\n b\n\nc ", "▁a▁ ▁b", "日本 語", "é é. x. y.z e.g. i.e.., ''s don't", "<|endoftext|> x<|startoftext|>y", "<s> </s> <0x0A> <unk>", "\x00\x01 \x1f", "İI ΣΑΣ ﬁ ½ ①", "3.14, a,b.c,", None]


def texts() -> list:
    rng = random.Random(7)
    alphabet = ["a", "b", "th", "the", " ", " ", "  ", "\n", ".", ",", "'s", "é", "▁", "日", "1", "́", "A", " ", "😀"]
    return ODD + ["".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(600)] + ["x y " * 5000, "z" * 3000]


def test_chunks_encode_and_decode_as_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = list(pieces.encode(pieces.ChunkTable(MODEL), pa.array(texts())))
    for text, (ids, digits, plain) in zip(texts(), got, strict=True):
        want = library.encode(text or "")
        assert ids == want, repr(text)
        assert digits == ",".join(map(str, want))
        assert plain == library.decode(want), repr(text)


def test_word_ids_as_the_library():
    library = Tokenizer.from_file(BPE)
    flat, at = packing.WordIds(BPE)(pa.array(texts()))
    for i, text in enumerate(texts()):
        assert flat[at[i] : at[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_other_models_encode_whole_texts():
    other = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = packing.WordIds(other), Tokenizer.from_file(other)
    assert packing.WordIds(BPE).apart and packing.WordIds(BPE).lower and not encoder.apart
    flat, at = encoder(pa.array(texts()))
    for i, text in enumerate(texts()):
        assert flat[at[i] : at[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)
    table = pieces.ChunkTable(MODEL)
    assert table.apart
    table.apart = False
    for (ids, digits, plain), (want, _, text) in zip(pieces.encode(table, pa.array(ODD)), pieces.encode(pieces.ChunkTable(MODEL), pa.array(ODD)), strict=True):
        assert (ids, plain) == (want, text) and digits == ",".join(map(str, want))


def test_encode_documents(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, "y")], "doc_id long, text string, ids string")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = sorted(pieces.encode_documents(docs, MODEL).collect(), key=str)
    assert [(r["doc_id"], r["ids"], r["decoded"]) for r in rows] == [(1, library.encode("a b"), "a b")] * 2 + [(None, [], "")]
    assert pieces.digest_documents(docs.limit(0), MODEL).collect() == []


def test_packing_places_every_piece(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6, None), (10**6 + 1, "")], "doc_id long, text string"))
    library = Tokenizer.from_file(BPE)
    rows = packing.pack(docs, BPE).collect()
    ids = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    sequences: dict = {}
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"] and len(own) == r["length"]
        assert r["start"] == 2048 * r["piece"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for placed in sequences.values():
        placed.sort()
        assert [x for x, _ in placed] == [sum(n for _, n in placed[:i]) for i in range(len(placed))]
        assert sum(n for _, n in placed) <= 2048
    least = -(-sum(map(len, ids.values())) // 2048)
    assert len(sequences) <= 1.03 * least + 2


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, length long"), BPE).collect() == []


@pytest.mark.parametrize("order", ["falling", "random"])
def test_sum_of_squares_against_trying_every_gap(order):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 33, 300)
    lengths = np.sort(lengths)[::-1] if order == "falling" else lengths
    where, offset = packing.sum_of_squares(lengths, 32)
    gaps: list[int] = []  # of every sequence
    for s, number, at in zip(lengths.tolist(), where.tolist(), offset.tolist(), strict=True):
        def squares(change: list[int]) -> int:
            return sum(sum(1 for g in change if g == h) ** 2 for h in range(1, 33))

        options = [squares([*gaps[:i], g - s, *gaps[i + 1 :]]) for i, g in enumerate(gaps) if g >= s] + [squares([*gaps, 32 - s])]
        if number == len(gaps):
            gaps.append(32)
        assert at == 32 - gaps[number]
        gaps[number] -= s
        assert squares(gaps) == min(options)
