"""Vectorised text helpers that run inside Spark tasks on Arrow buffers.

Texts of a batch are taken as one run of UTF-8 bytes with document offsets, in pieces of bounded size (a
single longer document is a piece of its own), so memory does not depend on how many rows a batch holds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = have = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def give_back() -> None:
    """Gives this process's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker, which other stages use again, gives its free memory back to the system."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


class SpanHash:
    """64-bit hashes of any spans of a byte array in constant time each; hashes of two odd bases are independent."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * powers(base, n), out=self.sums[1:])
        self.back = powers(_INVERSE if base == _BASE else pow(base, -1, 1 << 64), n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * _M2)


class Piece:
    """Consecutive documents: ``data`` bytes, ``offsets`` of n+1 document bounds, ``rows`` their places in the batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1
        self.rows = slice(first, first + self.n)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each maximal run of bytes other than space and U+0009 to U+000D."""
        d, o = self.data, self.offsets
        if not len(d):
            z = np.zeros(0, dtype=np.int64)
            return z, z, z
        word = (d != 32) & ((d < 9) | (d > 13))
        first, last = np.ones(len(d), dtype=bool), np.ones(len(d), dtype=bool)
        np.logical_not(word[:-1], out=first[1:])
        np.logical_not(word[1:], out=last[:-1])
        full = o[:-1] < o[1:]
        first[o[:-1][full]] = True
        last[o[1:][full] - 1] = True
        start, end = np.flatnonzero(word & first), np.flatnonzero(word & last) + 1
        return start, end, np.searchsorted(o, start, side="right") - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[Piece]:
    """Pieces of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    if column.null_count:
        size = np.diff(offsets)
        size[column.is_null().to_numpy(zero_copy_only=False)] = 0
        if size.sum() != offsets[-1] - offsets[0]:  # bytes behind a null
            column = column.fill_null(b"")
            yield from pieces(column, most)
            return
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n)
        yield Piece(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def spaced(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def window_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive word hashes, in order; shorter by size - 1."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for t in range(size):
        out *= np.uint64(_BASE)
        out += words[t : t + n]
    return mix(out)


def sliding_argmin(order: np.ndarray, width: int) -> np.ndarray:
    """Leftmost place of the least value in each ``width`` neighbours; the upper 32 bits of ``order`` count."""
    x = (order & ~np.uint64(0xFFFFFFFF)) | np.arange(len(order), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return (x & np.uint64(0xFFFFFFFF)).astype(np.int64)


def binaries(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column: for each count, so many items of ``flat``."""
    ends = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts * flat.itemsize, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])
