"""Draws of many replicates for many rows at once: md5 over NumPy arrays, inside tasks.

A draw is 32 bits of the md5 of (seed, kind, block, id); each hash serves LANES replicates.  Rows times blocks hashes are what a
resampling costs, so they are taken as arrays of rows by blocks: a word of the message depends on the row, on the block or on neither.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: A 128-bit hash serves so many replicates.
LANES = 4
#: Hashes that are taken together at most (calls of NumPy cost as much as several thousand of them), and draws that are handed over together.
TILE, HANDED = 1 << 16, 1 << 20

_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
# numbers as arrays: NumPy takes them in half the time of a number
_SINES = [np.array(int(abs(math.sin(i + 1)) * 2**32), np.uint32) for i in range(64)]
_WORDS = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *((7 * i) % 16 for i in range(16))]
_START = [np.array(x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_LEFT, _RIGHT = [np.array(n, np.uint32) for n in _SHIFTS], [np.array(32 - n, np.uint32) for n in _SHIFTS]


def _function(i: int, b: np.ndarray, c: np.ndarray, d: np.ndarray, f: np.ndarray) -> None:
    if i < 16:
        np.bitwise_xor(c, d, f), np.bitwise_and(f, b, f), np.bitwise_xor(f, d, f)
    elif i < 32:
        np.bitwise_xor(b, c, f), np.bitwise_and(f, d, f), np.bitwise_xor(f, c, f)
    elif i < 48:
        np.bitwise_xor(b, c, f), np.bitwise_xor(f, d, f)
    else:
        np.invert(d, f), np.bitwise_or(f, b, f), np.bitwise_xor(f, c, f)


def _turned(i: int, a: np.ndarray, b: np.ndarray, f: np.ndarray) -> None:
    np.left_shift(a, _LEFT[i], f), np.right_shift(a, _RIGHT[i], a), np.bitwise_or(a, f, a), np.add(a, b, a)


def _addends(blocks: np.ndarray, by_block: np.ndarray) -> list[np.ndarray]:
    """What each of the 64 steps adds for every row: a number, or one for each block."""
    return [np.asarray((blocks[:, w] if by_block[w] else blocks[0, w]) + sine) for w, sine in zip(_WORDS, _SINES)]


def _compress(state: list[np.ndarray], rows: np.ndarray, same: list[np.ndarray], by_row: np.ndarray, f: np.ndarray, first: int = 0) -> list[np.ndarray]:
    """One 64-byte step of md5 from its step ``first`` on, in place on arrays of rows by blocks.  rows: the words' parts by row; same:
    _addends(); f: room for one more such array."""
    a, b, c, d = state
    for i in range(first, 64):
        _function(i, b, c, d, f)
        np.add(a, f, a)
        if not by_row[w := _WORDS[i]]:
            np.add(a, same[i], a)
        elif same[i].ndim:
            np.add(a, same[i], a), np.add(a, rows[:, w, None], a)
        else:
            np.add(a, rows[:, w, None] + same[i], a)
        _turned(i, a, b, f)
        a, b, c, d = d, a, b, c
    return [a, b, c, d]


def _opened(many: int, same: list[np.ndarray], by_row: list[bool]) -> tuple[int, list[np.ndarray]]:
    """A message's steps before a word depends on the row, once for all rows: how many, and the state of ``many`` blocks after them."""
    steps = by_row.index(True) if True in by_row else 16
    a, b, c, d = (np.full(many, x, np.uint32) for x in _START)
    f = np.empty_like(a)
    for i in range(steps):
        _function(i, b, c, d, f)
        a = a + f + same[i]
        _turned(i, a, b, f)
        a, b, c, d = d, a, b, c
    return steps, [a, b, c, d]


def _hashes(prefix: bytes, lo: int, hi: int, ids: np.ndarray, out: np.ndarray) -> None:
    """Digests of prefix, block (lo to hi, numbers of equally many digits) and id into out[row, lane, block].  ids: bytes by row."""
    digits, size = len(str(lo)), ids.shape[1]
    at = len(prefix) + digits
    end = at + size
    length = (end + 8) // 64 * 64 + 64
    blocks = np.zeros((hi - lo, length), np.uint8)
    blocks[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
    numbers = np.arange(lo, hi)
    for k in range(digits):
        blocks[:, len(prefix) + k] = numbers // 10 ** (digits - 1 - k) % 10 + ord("0")
    blocks[:, end], blocks[:, length - 8 :] = 0x80, np.frombuffer((8 * end).to_bytes(8, "little"), np.uint8)
    rows = np.zeros((len(ids), length), np.uint8)
    rows[:, at:end] = ids
    rows, blocks, first = rows.view("<u4"), blocks.view("<u4"), 4 * np.arange(length // 4)
    by_row, by_block = ((first + 4 > at) & (first < end)).tolist(), (first + 4 > len(prefix)) & (first < at)
    many = -(-len(ids) // -(-len(ids) * (hi - lo) // TILE))  # rows in equal parts
    room = np.empty((9, many, hi - lo), np.uint32)
    shown = out.view(">u4")  # a digest's hexadecimal text shows the bytes of its words in order
    with np.errstate(over="ignore"):
        parts = [(slice(w, w + 16), _addends(blocks[:, w : w + 16], by_block[w : w + 16]), by_row[w : w + 16]) for w in range(0, length // 4, 16)]
        done, opened = _opened(hi - lo, *parts[0][1:])
        for i in range(0, len(ids), many):
            some = rows[i : i + many]
            work = room[:, : len(some)]
            state, f = list(work[:4]), work[8]
            for x, y in zip(state, opened):
                x[:] = y
            for k, (words, same, of_row) in enumerate(parts):
                before = np.stack(state, out=work[4:8]) if k else _START
                state = _compress(state, some[:, words], same, of_row, f, 0 if k else done)
                for x, y in zip(state, before):
                    np.add(x, y, x)
            for j, x in enumerate(state):
                shown[i : i + many, j] = x


def draws(prefix: str, ids: list[str], replicates: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, u): indexes of some ids and their draws, in rows by in_order()'s columns, until all ids had theirs.

    A draw is a lane of the md5 of prefix, block and id."""
    many, coded = -(-replicates // LANES), [x.encode() for x in ids]
    sizes = np.array([len(x) for x in coded])
    step = max(HANDED // (many * LANES), 1)
    for size in np.unique(sizes):
        of_size = np.flatnonzero(sizes == size)
        for i in range(0, len(of_size), step):
            rows = of_size[i : i + step]
            text = np.frombuffer(b"".join(coded[r] for r in rows), np.uint8).reshape(len(rows), size)
            u = np.empty((len(rows), LANES, many), np.uint32)
            lo = 0
            while lo < many:
                hi = min(many, 10 ** len(str(lo)))
                _hashes(prefix.encode(), lo, hi, text, u[:, :, lo:hi])
                lo = hi
            yield rows, u.reshape(len(rows), -1)


def in_order(sums: np.ndarray, replicates: int) -> np.ndarray:
    """Sums over draws()'s rows, whose last axis is its columns, by replicate: 4 * block + lane."""
    by = sums.reshape(*sums.shape[:-1], LANES, -1)
    return np.moveaxis(by, -2, -1).reshape(*sums.shape)[..., :replicates]
