"""Minimal perfect hashes of 64-bit keys, in numpy.

Each key sets a bit of a level if no other key left wants the same one; the others go on
to the next level. A key's slot is the number of bits set before its own, so n keys have
the slots 0 to n - 1. The keys are stored by slot: a lookup that meets another key says -1.
"""

from __future__ import annotations

import pickle

import numpy as np

from .text import mix

#: Bits of a level for each key that is left.
ROOM = 1.7


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """The slots of a set of distinct 64-bit keys."""

    def __init__(self, keys: np.ndarray):
        left, words = keys.astype(np.uint64), []
        self.sizes: list[int] = []
        while len(left):
            size = -(-int(ROOM * len(left) + 1) // 64) * 64
            at = _place(left, len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
            self.sizes.append(size)
            if len(self.sizes) > 200:
                raise ValueError("the keys are not distinct")
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.keys = np.zeros(len(keys), np.uint64)
        if len(keys):
            self.keys[self._slots(keys.astype(np.uint64))] = keys

    def __len__(self) -> int:
        return len(self.keys)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of the first set bit that a key meets; -1 without one."""
        out = np.full(len(keys), -1, np.int64)
        live, first = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = _place(keys[live], level, size) + first
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[live[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(below)
            live, first = live[~hit], first + size
            if not len(live):
                break
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key that is in the set, -1 for any other."""
        keys = keys.astype(np.uint64)
        out = self._slots(keys)
        met = np.flatnonzero(out >= 0)
        out[met[self.keys[out[met]] != keys[met]]] = -1
        return out

    def dumps(self) -> bytes:
        return pickle.dumps((self.sizes, self.words, self.before, self.keys), protocol=5)

    @classmethod
    def loads(cls, body: bytes) -> PerfectHash:
        out = cls.__new__(cls)
        out.sizes, out.words, out.before, out.keys = pickle.loads(body)
        return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard that a key is dealt to."""
    return (mix(keys.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(shards)).astype(np.int64)
