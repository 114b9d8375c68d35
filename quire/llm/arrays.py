"""Whole-text word and n-gram arithmetic on Arrow string columns with numpy.

A batch of texts is one UTF-8 byte buffer with offsets; words are the maximal runs of bytes other than
0x20 and 0x09-0x0D (UTF-8 continuation bytes never fall in that set, so this equals the code-point pattern
``[^\\x20\\x09-\\x0D]+``).  Hashes are 64-bit polynomials modulo 2**64 over mixed symbols, taken from prefix sums, so
every n-gram of a batch costs a few vector operations, however long n is.

Nulls count as empty texts here; callers that must tell them apart look at the column's validity.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

BASE, OTHER_BASE = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F
CHUNK_BYTES = 1 << 20
_U = np.uint64
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x + _U((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and extended by doubling."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, _U)
    while len(have) < n:
        step = _U(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    if len(have) <= 4 * CHUNK_BYTES:
        _powers[base] = have
    return have[:n]


_BYTE, _OTHER_BYTE = (mix(np.arange(1, 257, dtype=_U), salt) for salt in (7, 8))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Prefix:
    """Prefix sums that give the hash of any range of a symbol sequence."""

    def __init__(self, symbols: np.ndarray, base: int = BASE):
        self.n = len(symbols)
        self.sums = np.zeros(self.n + 1, _U)
        np.cumsum(symbols * powers(base, self.n), out=self.sums[1:])
        self.inverse = powers(pow(base, -1, 1 << 64), self.n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def grams(self, k: int) -> np.ndarray:
        """Hash of each run of k symbols, by its start."""
        m = max(0, self.n - k + 1)
        return (self.sums[k : k + m] - self.sums[:m]) * self.inverse[:m]


@dataclass
class Words:
    """The words of consecutive texts. first[d]:first[d+1] are the words of text d."""

    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # by word, in data
    end: np.ndarray
    first: np.ndarray  # by text
    hashes: np.ndarray  # by word
    others: np.ndarray | None = None  # by word, of an independent hash, where asked for

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, twice: bool = False) -> Words:
    """Words of the texts data[offsets[i]:offsets[i+1]]; lower folds A-Z before hashing, twice gives a second hash."""
    base, data = offsets[0], data[offsets[0] : offsets[-1]]
    offsets = offsets - base
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    bounds = offsets[1:-1]
    bounds = bounds[bounds < len(data)]
    begins[bounds] = inside[bounds]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = bounds[bounds > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = (end - start).astype(_U)
    hashes = mix(Prefix(_BYTE[data]).hash(start, end) + size)
    others = mix(Prefix(_OTHER_BYTE[data], OTHER_BASE).hash(start, end) + size, 1) if twice else None
    return Words(data, start, end, np.searchsorted(start, offsets), hashes, others)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most limit bytes together; a longer text makes a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def slices(batch: pa.RecordBatch, text: int = 0, limit: int = 4 * CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts have at most limit bytes together, or one row."""
    for i, j in chunks(buffers(batch.column(text))[1], limit):
        yield batch.slice(i, j - i)


def word_chunks(column: pa.Array, lower: bool = False, twice: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first text, end text, their words), chunk by chunk, over whole texts."""
    data, offsets = buffers(column)
    for i, j in chunks(offsets):
        yield i, j, words(data, offsets[i : j + 1], lower, twice)


def window_start(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts of counts words: (word index, text) of each start of k words within one text."""
    per = np.maximum(counts - k + 1, 0)
    total = int(per.sum())
    doc = np.repeat(np.arange(len(counts)), per)
    first = np.cumsum(counts) - counts
    inner = np.arange(total) - np.repeat(np.cumsum(per) - per, per)
    return first[doc] + inner, doc


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, .. (length[0] of them), then those of start[1], ..."""
    total = int(length.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(length) - length), length)


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, after which a worker gives freed memory back, as the same worker runs the tasks of later stages."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        _powers.clear()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            return

    return run
