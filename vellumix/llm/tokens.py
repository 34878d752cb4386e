"""Vectorised word hashing over Arrow text columns.

A word is a run of bytes outside {0x20, 0x09-0x0D}.  Bytes >= 0x80 belong to
words, so working on UTF-8 gives the same words as working on code points.
Every routine walks a column in groups of whole documents, so memory follows
the largest document and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 18
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_WORD_BASE, _OTHER_BASE = _U(0xD1342543DE82EF95), _U(0xC6A4A7935BD1E995)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=_U) * _BASE + _U(seed))


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters, digits and bytes from 0x80.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_CODES = stream64(256, 7)
_LOWER_CODES = _CODES.copy()
_LOWER_CODES[65:91] = _CODES[97:123]


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, _U(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=_U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), GROUP_BYTES + 1)
            for name, x in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, x, dtype=_U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=_U))
        return self.up, self.down


_bytes_powers, _word_powers, _other_powers = _Powers(_BASE), _Powers(_WORD_BASE), _Powers(_OTHER_BASE)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run; after its last batch, memory that its allocators keep goes back to the system, as Spark keeps idle workers."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.dtype(np.int64 if large else np.int32)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, kind, count=len(column) + 1, offset=column.offset * kind.itemsize)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), ends.astype(np.int64)


def doc_groups(offsets: np.ndarray, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most `most` bytes, or one larger document."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, bounds: np.ndarray, apart: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word in data, and each document's first word.

    bounds: the documents' offsets in data, from 0 to len(data); apart: which bytes separate words.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    space = apart[data]
    left, right = np.empty(n, bool), np.empty(n, bool)
    left[0], right[-1] = True, True
    left[1:], right[:-1] = space[:-1], space[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    left[inner], right[inner - 1] = True, True
    word = ~space
    starts, ends = np.flatnonzero(word & left), np.flatnonzero(word & right) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit polynomial hash of each word, whatever its place."""
    if not len(starts):
        return np.zeros(0, _U)
    n = len(data)
    up, down = _bytes_powers(n + 1)
    sums = np.empty(n + 1, _U)
    sums[0] = 0
    np.cumsum((_LOWER_CODES if lower else _CODES)[data] * up[:n], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def word_hashes(column, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each group of documents: first, end, word hashes, word offsets."""
    data, offsets = text_buffers(column)
    for lo, hi in doc_groups(offsets):
        part = data[offsets[lo] : offsets[hi]]
        starts, ends, first = word_spans(part, offsets[lo : hi + 1] - offsets[lo])
        yield lo, hi, hash_words(part, starts, ends, lower), first


def prefix_sums(words: np.ndarray) -> np.ndarray:
    """What run_hashes needs to hash any run of these words."""
    up, _ = _word_powers(len(words) + 1)
    sums = np.empty(len(words) + 1, _U)
    sums[0] = 0
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return sums


def run_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hashes of runs of any widths, as rolling() has them."""
    _, down = _word_powers(len(sums))
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def other_rolling(words: np.ndarray, width: int) -> np.ndarray:
    """A second hash of every run, over another base."""
    return rolling(words, width, _other_powers)


def rolling(words: np.ndarray, width: int, powers: _Powers = _word_powers) -> np.ndarray:
    """Rabin-Karp hash of every run of `width` words, documents' ends ignored."""
    n = len(words)
    if n < width:
        return np.zeros(0, _U)
    up, down = powers(n + 1)
    sums = np.empty(n + 1, _U)
    sums[0] = 0
    np.cumsum(words * up[:n], out=sums[1:])
    return mix64((sums[width:] - sums[: n - width + 1]) * down[: n - width + 1] + _U(width))


def inside(first: np.ndarray, width: int) -> np.ndarray:
    """Which runs of `width` words of a group lie within one document."""
    total = int(first[-1])
    if total < width:
        return np.zeros(0, bool)
    owner = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    return owner[: total - width + 1] == owner[width - 1 :]


def shingle_sets(column, width: int, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text; a text of fewer words is one shingle."""
    for lo, hi, words, first in word_hashes(column, lower):
        runs = rolling(words, width)
        for i in range(hi - lo):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= width:
                yield lo + i, np.unique(runs[a : b - width + 1])
            else:
                yield lo + i, rolling(words[a:b], b - a) if b > a else np.zeros(0, _U)
