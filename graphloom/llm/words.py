"""Words of Arrow string batches as numpy arrays, without a Python object per word.

A word is a run of bytes other than ASCII white space (0x20, 0x09 to 0x0D).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes worked on at a time; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Text bytes whose prefix sums are held at a time.
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``most`` bytes of text each, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and each text's offset in them (one more than texts); null is empty."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if at else np.zeros(len(texts) + 1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in ``data``, and each text's offset in the list of words."""
    blank = _SPACE[data]
    first, last = np.ones(len(data), bool), np.ones(len(data), bool)
    first[1:], last[:-1] = blank[:-1], blank[1:]
    inside = offsets[(offsets > 0) & (offsets < len(data))]
    first[inside], last[inside - 1] = True, True
    starts, ends = np.flatnonzero(first & ~blank), np.flatnonzero(last & ~blank) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: near inputs get unrelated outputs."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2**64."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        base = pow(_BASE, -1, 2**64) if inverse else _BASE
        steps = np.full(max(n, BLOCK_BYTES), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= BLOCK_BYTES:
            _powers[inverse] = have
    return have[:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[s:e]`` for every range; ranges are in order and don't overlap.

    A polynomial of the values by prefix sums, block by block, then mixed.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        origin = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, origin + BLOCK_BYTES - 1, "right")))
        part = values[origin : ends[to - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(len(part)), out=sums[1:])
        s, e = starts[at:to] - origin, ends[at:to] - origin
        out[at:to] = (sums[e] - sums[s]) * powers(len(part) + 1, inverse=True)[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; ``lower`` maps A-Z to a-z first."""
    table = _BYTE_LOWER if lower else _BYTE
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):  # so that the eight bytes a value never exist for the whole text
        origin = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, origin + BLOCK_BYTES - 1, "right")))
        out[at:to] = range_hashes(table[data[origin : ends[to - 1]]], starts[at:to] - origin, ends[at:to] - origin)
        at = to
    return out


def vocabulary(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts, the code of every word in order, and each text's offset among the codes."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    table = lists.flatten().dictionary_encode()
    codes, words = table.indices.to_numpy(zero_copy_only=False), table.dictionary
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    blank = pc.index(words, pa.scalar("", words.type)).as_py()
    if blank >= 0:  # before leading and after trailing white space
        keep = codes != blank
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return words, codes, offsets


def gather(flat: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``flat[starts[c]:starts[c + 1]]`` of all codes in order, joined; and where each begins (one more than codes)."""
    sizes = (starts[1:] - starts[:-1])[codes]
    ends = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    return flat[np.repeat(starts[:-1][codes] - ends[:-1], sizes) + np.arange(ends[-1])], ends
