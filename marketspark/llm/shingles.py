"""Shingle sets of texts as sorted 64-bit hashes; helpers that run inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
BITMAP_LONGS = 16  # at least; a larger set has the next power of two with a bit for each hash
LOW_SHARE = 0.3  # more than a link leaves over at 80 percent; changes the work, not the result


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes; a text of fewer words gives its whole sequence, no words give none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.int64)
    known: dict[bytes, int] = {}
    w = np.fromiter((known.get(x) or known.setdefault(x, xxhash.xxh64_intdigest(x)) for x in found), np.uint64, len(found))
    n = max(1, len(w) - width + 1)
    h = np.full(n, min(width, len(w)), np.uint64)
    for j in range(min(width, len(w))):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n])
    return np.unique(h.view(np.int64))


def bitmap(s: np.ndarray) -> np.ndarray:
    """One bit per hash by its low bits, so OR-ing the halves of a bitmap gives the one of half the width."""
    longs = BITMAP_LONGS
    while longs * 64 < len(s):
        longs *= 2
    bits = np.zeros(longs * 64, np.uint8)
    bits[(s.view(np.uint64) >> np.uint64(7)) % np.uint64(len(bits))] = 1
    return np.packbits(bits).view(np.int64)


def low_end(s: np.ndarray) -> np.ndarray:
    """The hashes in the lowest ``LOW_SHARE`` of the hash range, the same range for all sets."""
    return s[: np.searchsorted(s, np.int64(-(1 << 63) + int(LOW_SHARE * (1 << 64))))]
