"""Minimal perfect hashing of 64-bit keys by levels of bit arrays (Limasset et al. 2017), in numpy."""

from __future__ import annotations

import numpy as np

GAMMA = 1.5


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    h = keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


class Mphf:
    """Places 0 to n - 1, one for each of n distinct keys; other keys get any place or -1."""

    def __init__(self, keys: np.ndarray | None = None):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # bits, words, set bits before each word
        left, base = np.zeros(0, np.uint64) if keys is None else keys.astype(np.uint64), 0
        while len(left):
            m = -(-max(64, int(GAMMA * len(left))) // 64) * 64
            at = (_mix(left, len(self.levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            counts = np.bitwise_count(words).astype(np.int64)
            self.levels.append((m, words, base + np.cumsum(counts) - counts))
            base += int(counts.sum())
            left = left[~alone[at]]
            if len(self.levels) > 200:
                raise ValueError("the keys are not distinct")
        self.n = base

    def places(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        keys = keys.astype(np.uint64)
        for level, (m, words, before) in enumerate(self.levels):
            if not len(todo):
                break
            at = (_mix(keys[todo], level) % np.uint64(m)).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            held = words[word]
            hit = held >> bit & np.uint64(1) == 1
            lower = held & (np.uint64(1) << bit) - np.uint64(1)
            out[todo[hit]] = before[word[hit]] + np.bitwise_count(lower[hit])
            todo = todo[~hit]
        return out

    def nbytes(self) -> int:
        return sum(w.nbytes + b.nbytes for _, w, b in self.levels)
