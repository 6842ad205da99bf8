"""Hashes of many slices of one buffer at once, from prefix sums of a polynomial modulo 2**64."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of the (odd) base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            out = []
            for base in (BASE, pow(BASE, -1, 1 << 64)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                out.append(np.multiply.accumulate(steps))
            self.up, self.down = out
        return self.up[:n], self.down[:n]


def slice_hashes(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """A non-negative 63-bit hash of every slice; it depends on the slice's symbols only, not on its place."""
    up, down = powers.upto(len(symbols) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    x = (total[end] - total[begin]) * down[begin]
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x >> np.uint64(1)).astype(np.int64)
