"""Simple-8b: whole numbers in 64-bit words, as many in each as its selector says.

The upper four bits of a word are its selector, the lower sixty its values, the first one lowest.
Selector 0 is the escape: its payload is a place in a list of values that sixty bits cannot hold.
Selector 1 stands for 120 zeros. Each block of BLOCK words has an offset: how many values stand
before it. Encoding and decoding are vectorised.
"""

from __future__ import annotations

import numpy as np

#: (values in a word, bits of each), by selector; fixed values of the format.
SELECTORS = [(1, 60), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([n for n, _ in SELECTORS], dtype=np.int64)
ESCAPE, BLOCK = 0, 128
#: Values that are encoded at a time; a word never reaches over them, so memory beside the result is bounded.
SEGMENT = 1 << 16


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, escapes, block offsets) of an array of unsigned values of up to 64 bits."""
    parts, known = [], 0
    for i in range(0, len(values), SEGMENT):
        words, escapes = _segment(np.asarray(values[i : i + SEGMENT], dtype=np.uint64))
        if known:
            words[words >> np.uint64(60) == ESCAPE] += np.uint64(known)
        known += len(escapes)
        parts.append((words, escapes))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    words, escapes = (np.concatenate(x) for x in zip(*parts, strict=True))
    counts = COUNTS[words >> np.uint64(60)]
    return words, escapes, (np.cumsum(counts) - counts)[::BLOCK].astype(np.uint64)


def _segment(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of some values, at least one."""
    n = len(values)
    choice = np.full(n, 15, dtype=np.uint8)
    small = values.astype(np.uint32) if n and values.max() < 1 << 32 else values
    for s in range(14, 0, -1):
        count, bits = SELECTORS[s]
        if count > n:
            break
        fits = small < small.dtype.type(1 << bits) if small.itemsize == 8 or bits < 32 else np.ones(n, dtype=bool)
        have = 1
        while have < count and fits.any():  # fits[i]: the have values from i on fit
            step = min(have, count - have)
            fits = fits[: len(fits) - step] & fits[step:]
            have += step
        if have == count and fits.any():
            np.copyto(choice[: len(fits)], s, where=fits)
    big = values >> np.uint64(60) != 0
    choice[big] = ESCAPE
    steps, at, starts = COUNTS[choice].tolist(), 0, []
    while at < n:
        starts.append(at)
        at += steps[at]
    first = np.array(starts, dtype=np.int64)
    picked = choice[first]
    words = picked.astype(np.uint64) << np.uint64(60)
    for s in np.unique(picked).tolist():
        count, bits = SELECTORS[s]
        here = np.flatnonzero(picked == s)
        if s == ESCAPE:
            words[here] |= np.arange(len(here), dtype=np.uint64)
        elif bits:
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            words[here] |= np.bitwise_or.reduce(values[first[here][:, None] + np.arange(count)] << shifts, axis=1)
    return words, values[first[picked == ESCAPE]]


def decode(words: np.ndarray, escapes: np.ndarray, before: int = 0) -> np.ndarray:
    """The values of words, which may be any whole blocks; before: escapes in earlier words."""
    picked = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[picked]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    for s in np.unique(picked).tolist():
        count, bits = SELECTORS[s]
        here = np.flatnonzero(picked == s)
        if s == ESCAPE:
            out[first[here]] = escapes[before : before + len(here)]
        elif bits:
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[first[here][:, None] + np.arange(count)] = words[here][:, None] >> shifts & np.uint64((1 << bits) - 1)
    return out
