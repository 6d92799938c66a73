"""Vectorised rolling hashes over the bytes and words of one text."""

from __future__ import annotations

import functools

import numpy as np

BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Polynomial hashes modulo 2**64 under one odd base."""

    def __init__(self, base: int):
        self.base = base
        self._inverse = pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            with np.errstate(over="ignore"):
                self._up, self._down = (np.concatenate(([np.uint64(1)], np.cumprod(np.full(2 * n, b, np.uint64)))) for b in (self.base, self._inverse))
        return self._up[:n], self._down[:n]

    def power(self, n: int) -> np.uint64:
        return np.uint64(pow(self.base, n, 1 << 64))

    def prefix_sums(self, data: np.ndarray) -> np.ndarray:
        """Sums by which ``span_hash`` hashes any span; one entry more than bytes."""
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._powers(len(data))[0], out=out[1:])
        return out

    def span_hash(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes in each [start, end), whatever its place."""
        return mix((sums[ends] - sums[starts]) * self._powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


@functools.lru_cache(maxsize=4)
def rolling(base: int = BASE) -> Rolling:
    """One set of powers a base and worker process."""
    return Rolling(base)


def word_hashes(text: str) -> np.ndarray:
    """Hash of each word: runs of bytes above 0x20 of the lower-cased text."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    inside = np.concatenate(([False], data > 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return rolling().span_hash(rolling().prefix_sums(data), edges[::2], edges[1::2])
