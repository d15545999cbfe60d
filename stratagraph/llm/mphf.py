"""A minimal perfect hash over 64-bit keys, vectorised.

Each level is a bit array; keys that are alone at their position of a level stay there, the others go
to the next level. A key's slot is the rank of its bit over all levels. About 3 to 4 bits a key.
"""

from __future__ import annotations

import struct

import numpy as np

from .common import mix64

_GOLDEN = 0x9E3779B97F4A7C15


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix64(keys + np.uint64((level + 1) * _GOLDEN % 2**64)) % np.uint64(size)


class PerfectHash:
    """Slots 0 to n-1 for n distinct keys; other keys get some slot or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bit arrays as uint64 words
        self.ranks = []
        at = 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(at + np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int64) if len(words) else np.zeros(0, np.int64))
            at += int(ones.sum())
        self.n = at

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.6) -> PerfectHash:
        keys = np.asarray(keys, dtype=np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys must be distinct")
        levels, rest = [], keys
        while len(rest):
            size = max(64, (int(len(rest) * gamma) + 63) // 64 * 64)
            at = _place(rest, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            rest = rest[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, dtype=np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        rest = np.arange(len(keys))
        for level, words in enumerate(self.levels):
            if not len(rest):
                break
            at = _place(keys[rest], level, len(words) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            value = words[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(value[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[rest[hit]] = self.ranks[level][word[hit]] + below
            rest = rest[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<I", len(x)) for x in self.levels)
        return head + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        (count,) = struct.unpack_from("<I", data)
        sizes = struct.unpack_from(f"<{count}I", data, 4)
        at, levels = 4 + 4 * count, []
        for size in sizes:
            levels.append(np.frombuffer(data, np.uint64, size, at))
            at += 8 * size
        return cls(levels)
