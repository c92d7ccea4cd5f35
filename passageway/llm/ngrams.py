"""Hashed character n-grams of whole texts."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)
#: Code points of a text that are hashed at once; a longer text is read in such stretches.
STRETCH = 1 << 20


def gram_slots(text: str, sizes: tuple[int, ...], bits: int):
    """Slots (below 2^bits) of all n-grams of the lower-cased text between two spaces, in arrays of bounded length."""
    points = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    shift = np.uint64(64 - bits)
    longest = max(sizes)
    for start in range(0, len(points), STRETCH):
        own = min(STRETCH, len(points) - start)
        c = points[start : start + own + longest - 1].astype(np.uint64)
        hashed = c + np.uint64(1)
        for n in range(1, longest + 1):
            if n > 1:
                hashed = hashed[:-1] * _STEP + c[n - 1 :] if len(hashed) > 1 else hashed[:0]
            if n in sizes:
                x = (hashed[:own] + np.uint64(n)) * _MIX
                yield ((x ^ (x >> np.uint64(29))) * _MIX >> shift).astype(np.int64)


def gram_counts(text: str, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """How often each slot occurs in the whole text."""
    out = np.zeros(1 << bits, dtype=np.int64)
    for slots in gram_slots(text, sizes, bits):
        out += np.bincount(slots, minlength=len(out))
    return out
