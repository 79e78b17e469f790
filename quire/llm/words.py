"""Words, word hashes and n-gram hashes of whole Arrow columns of text, without a Python loop over words.

A batch is cut into slabs of whole documents (about SLAB bytes, one document at least), so memory stays bounded
however many documents a batch holds; only a single document is ever held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.default_rng(20260)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64 to the powers 0..n, kept for the life of the worker."""
    if len(_powers[0]) <= n:
        size = max(SLAB + 1, n + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Slab:
    """Documents first..last-1 of a batch; data holds their bytes, bounds where each begins (one more than documents)."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray

    def lowered(self) -> Slab:
        return Slab(self.first, self.last, _LOWER[self.data], self.bounds)


@dataclass
class Words:
    """begin/end: byte positions in the slab; doc: document within the slab; at: first word of each document."""

    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    at: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.at)


def binary(column: pa.Array) -> pa.LargeBinaryArray:
    """UTF-8 bytes of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.cast(column, pa.large_binary())
    return pc.fill_null(column, b"") if column.null_count else column


def slabs(column: pa.Array, limit: int = SLAB) -> Iterator[Slab]:
    array = binary(column)
    n = len(array)
    if not n:
        return
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + n + 1]
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        low, high = offsets[first], offsets[last]
        yield Slab(first, last, data[low:high], offsets[first : last + 1] - low)
        first = last


def words(slab: Slab) -> Words:
    """Maximal runs of bytes other than space and 0x09-0x0D; a document's end also ends a word."""
    inside = ~_SPACE[slab.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[slab.bounds] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    after = np.zeros(len(inside), bool)
    if len(inside):
        after[:-1] = ~inside[1:] | edge[1:-1]
        after[-1] = True
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(after & inside) + 1
    at = np.searchsorted(starts, slab.bounds)
    doc = np.repeat(np.arange(slab.last - slab.first), np.diff(at))
    return Words(starts, ends, doc, at)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans: equal for equal bytes, wherever they stand."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64, out=sums[1:])
    value = (sums[end] - sums[begin]) * inverse[begin]
    return mix(value + (end - begin).astype(np.uint64))


def word_hashes(slab: Slab, found: Words) -> np.ndarray:
    return span_hashes(slab.data, found.begin, found.end)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive values; the last n - 1 positions have none (callers mask document ends)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:m].copy()
    for k in range(1, n):
        total = total * _BASE + hashes[k : k + m]
    return mix(total)


def gram_starts(found: Words, n: int) -> np.ndarray:
    """Word positions at which n words of one document begin."""
    m = len(found.doc) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(found.doc[:m] == found.doc[n - 1 :])
