"""Words of many joined texts at once, as 64-bit hashes."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    row = np.full(n, base, np.uint64)
    row[:1] = 1
    return np.multiply.accumulate(row)


class Words(NamedTuple):
    """Words of joined texts: 64-bit hashes, where each begins and ends, and the text it belongs to."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray


def words_of(joined: np.ndarray, offsets: np.ndarray, letter: np.ndarray) -> Words:
    """Runs of bytes in ``letter`` of all texts at once, A-Z lowered; a word never crosses a text's end."""
    low = LOWER[joined]
    inside = letter[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(low))]
    begins[edges] = inside[edges]
    finish[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    hashes = np.empty(len(starts), np.uint64)
    # A polynomial of the bytes: differences of running sums, moved back to power zero; in parts to bound the memory.
    part = 1 << 20
    longest = int((ends - starts).max()) if len(starts) else 0
    up = _powers(BASE, max(part, longest))
    down = _powers(pow(BASE, -1, 1 << 64), max(part, longest) + 1)
    first = 0
    while first < len(starts):
        last = int(np.searchsorted(ends, starts[first] + part, side="right"))
        last = max(last, first + 1)
        a, b = int(starts[first]), int(ends[last - 1])
        n = b - a
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((low[a:b].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        left, right = starts[first:last] - a, ends[first:last] - a
        hashes[first:last] = (sums[right] - sums[left]) * down[left]
        first = last
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    return Words(hashes, starts, ends, np.searchsorted(offsets, starts, side="right") - 1)
