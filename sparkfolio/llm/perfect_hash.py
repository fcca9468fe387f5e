"""Minimal perfect hashing of 64-bit keys, vectorised: levels of bit arrays (Limasset, Rizk, Chikhi and Peterlongo 2017).

A key's place in a level is its hash with that level; places that one key alone has are set, the other keys go on to the next
level.  A key's slot is the rank of its bit among all levels, so n keys have the slots 0 to n - 1, at about 4 bits a key.
"""

from __future__ import annotations

import numpy as np

from .text import mix

_STEP = 0x9E3779B97F4A7C15


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((_STEP * (level + 1)) % (1 << 64))
    return (mix(keys ^ seed) % np.uint64(size)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of levels, all levels' bits packed one level after another) for distinct ``keys``."""
    sizes, bits = [], []
    while len(keys):
        size = (len(keys) + 7) // 8 * 8
        place = _place(keys, len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        sizes.append(size)
        bits.append(np.packbits(alone, bitorder="little"))
        keys = keys[~alone[place]]
    return np.array(sizes, dtype=np.int64), np.concatenate(bits) if bits else np.zeros(0, dtype=np.uint8)


class PerfectHash:
    """Slots of keys by what ``build`` made; a key that wasn't there gets any slot or -1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes = sizes
        self.bits = np.unpackbits(bits, bitorder="little")
        self.rank = np.cumsum(self.bits, dtype=np.int64) - 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = np.full(len(keys), -1, dtype=np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            place = base + _place(keys[left], level, size)
            hit = self.bits[place] == 1
            slot[left[hit]] = self.rank[place[hit]]
            left, base = left[~hit], base + size
        return slot
