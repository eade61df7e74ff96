"""A minimal perfect hash over distinct 64-bit keys, built and probed in whole arrays.

Keys that fall alone into a slot of a level's bit array are settled there; the others go on to the next
level. A key's number is the count of set bits before its own, over all levels.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0
MOST_LEVELS = 48


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    h = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class MinimalPerfectHash:
    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        self.rank, before = [], 0
        for b in bits:
            self.rank.append(np.cumsum(b, dtype=np.int64) - b + before)
            before += int(b.sum())
        self.size = before

    @classmethod
    def build(cls, keys: np.ndarray) -> "MinimalPerfectHash":
        bits, left = [], keys
        while len(left):
            if len(bits) == MOST_LEVELS:
                raise ValueError("the keys aren't distinct")
            size = max(64, int(GAMMA * len(left)))
            slot = (_mix(left, len(bits)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            bits.append(alone)
            left = left[~alone[slot]]
        return cls(bits)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, from 0; for a key that wasn't built in, any number or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, b in enumerate(self.bits):
            slot = (_mix(keys[open_], level) % np.uint64(len(b))).astype(np.int64)
            hit = b[slot]
            out[open_[hit]] = self.rank[level][slot[hit]]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> tuple[bytes, list[int]]:
        return b"".join(np.packbits(b).tobytes() for b in self.bits), [len(b) for b in self.bits]

    @classmethod
    def from_bytes(cls, data: bytes, sizes: list[int]) -> "MinimalPerfectHash":
        bits, at = [], 0
        for n in sizes:
            width = (n + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=n).astype(bool))
            at += width
        return cls(bits)
