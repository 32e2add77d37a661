"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the model has a white-space marker after another character,
a text falls apart before every run of markers, and the parts encode alone as
they do inside the text. Each slice of texts becomes a table of distinct chunks
(markers and the word after them) and a list of positions; the library encodes
and decodes each distinct chunk once, and ids are joined back by position.
Under a model with other pieces, or one that treats white space otherwise,
whole texts are encoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import words as w

MARKER = "▁"
#: Texts by which a model shows how it treats white space.
PROBES = ["", " ", "  ", "a", " a", "a ", "  a  b   ", "a\n b\n\nc ", "the cat  sat\ton a mat. ", "▁a▁ ▁b", "É é 日本 語 ﬁ①"]
#: Chunks that a worker remembers.
REMEMBERED = 300_000


class ChunkTable:
    """Ids and text of chunks; a chunk is written as its markers but one, as spaces, and its word."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.known: dict[str, tuple[list[int], str, str]] = {}
        self.apart = not any(MARKER in x.lstrip(MARKER) for x in names)
        self.apart = self.apart and [x[0] for x in encode(self, pa.array(PROBES))] == self.model.encode(PROBES, num_threads=1)

    def learn(self, chunks: list[str]) -> None:
        """Encode and decode those chunks that are new."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({x for x in chunks if x not in self.known and x})
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            ids = self.model.encode(some, num_threads=1)
            self.known.update((x, (y, ",".join(map(str, y)), z)) for x, y, z in zip(some, ids, self.model.decode(ids, num_threads=1), strict=True))
        lone = self.model.piece_to_id(MARKER)
        self.known[""] = ([lone], str(lone), "")  # one marker and no word, as after a text's last space

    @staticmethod
    def split(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct chunks, the code of every chunk in order, and each text's offset among the codes."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARKER, " ")  # the library takes a marker for a space
        lists = pc.split_pattern(texts, " ")
        table = lists.flatten().dictionary_encode()
        words, codes = table.dictionary.to_pylist(), table.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at = lists.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        some = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        blank = codes == words.index("") if "" in words else np.zeros(len(codes), bool)
        if not blank.any():
            return words, codes, at
        last = np.zeros(len(codes), bool)
        last[at[1:] - 1] = True
        # markers before a word: itself and the blanks up to it, not past the text's begin
        place = np.arange(len(codes))
        begin = np.repeat(at[:-1], np.diff(at))
        solid = np.maximum.accumulate(np.where(blank, -1, place))
        before = np.concatenate([[-1], solid[:-1]]) if len(solid) else solid
        run = place - np.maximum(before, begin - 1) - 1
        keep = (~blank | last) & np.repeat(some, np.diff(at))
        made: dict[str, int] = {}
        lists_of = [made.setdefault(" " * k + words[c], len(made)) for c, k in zip(codes[keep].tolist(), run[keep].tolist(), strict=True)]
        return list(made), np.array(lists_of, np.int64), np.concatenate([[0], np.cumsum(keep)])[at]


def encode(table: ChunkTable, texts: pa.Array) -> Iterator[tuple[list[int], str, str]]:
    """Ids of each text, the ids as digits joined by commas, and the text decoded again."""
    if not table.apart:
        for text in texts.to_pylist():
            ids = table.model.encode(text or "")
            yield ids, ",".join(map(str, ids)), table.model.decode(ids)
        return
    chunks, codes, at = table.split(texts)
    table.learn(chunks)
    rows = [table.known[x] for x in chunks]
    listed = codes.tolist()
    for i in range(len(at) - 1):
        own = [rows[c] for c in listed[at[i] : at[i + 1]]]
        yield [y for x in own for y in x[0]], ",".join([x[1] for x in own]), " ".join([x[2] for x in own])


def _digests(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        for batch in batches:
            for part in w.slices(batch):
                if not table.apart:
                    own = [(len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (digits, plain))) for ids, digits, plain in encode(table, part.column("text"))]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], pa.string()), pa.array([x[2] for x in own], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                    continue
                chunks, codes, at = table.split(part.column("text"))
                table.learn(chunks)
                rows = [table.known[x] for x in chunks]
                sizes = np.concatenate([[0], np.cumsum(np.array([len(x[0]) for x in rows], np.int64)[codes])]) if len(codes) else np.zeros(1, np.int64)
                digits, plain = [x[1] for x in rows], [x[2] for x in rows]
                ids_sha, text_sha, listed = [], [], codes.tolist()
                for i in range(len(part)):
                    own = listed[at[i] : at[i + 1]]
                    ids_sha.append(hashlib.sha256(",".join([digits[c] for c in own]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(" ".join([plain[c] for c in own]).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(sizes[at])), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _both(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        for batch in batches:
            for part in w.slices(batch):
                out = list(encode(table, part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in out], pa.list_(pa.int32())), pa.array([x[2] for x in out], pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encode_documents(documents: DataFrame, model: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` of every row of ``documents (doc_id, text)``, exactly as the library gives them for the whole text.

    A null text is empty, and an empty text has no ids. Repeated rows are
    repeated, a null doc_id stays null, other columns are ignored, an empty
    table gives no rows. Texts are encoded whole, however long.
    """
    return _rows(documents).mapInArrow(_both(model), "doc_id long, ids array<int>, decoded string")


def digest_documents(documents: DataFrame, model: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: digests of what ``encode_documents`` gives, without moving it; rows as there."""
    return _rows(documents).mapInArrow(_digests(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
