"""Hashes of byte strings at every position of a buffer, by numpy prefix sums."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multipliers; arithmetic is modulo 2**64.
BASE, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(MIX1)
    h = (h ^ (h >> U(29))) * U(MIX2)
    return h ^ (h >> U(32))


class Hasher:
    """Polynomial hashes of substrings of buffers of up to `most` bytes. fold: A-Z hash as a-z."""

    def __init__(self, most: int, seed: int = 1, fold: bool = False):
        rng = np.random.default_rng(seed)
        self.lut = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
        if fold:
            self.lut[65:91] = self.lut[97:123]
        self.most = 0
        self._grow(most)

    def _grow(self, most: int) -> None:
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(most, BASE, np.uint64))), dtype=np.uint64)
            back = pow(BASE, -1, 1 << 64)
            self.inverse = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(most, back, np.uint64))), dtype=np.uint64)
        self.most = most

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """n + 1 prefix sums of a buffer."""
        if len(data) > self.most:
            self._grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.lut[data] * self.power[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of buffer[start:end], for arrays of starts and ends."""
        return mixed((prefix[end] - prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Mixed hashes of every k bytes."""
        return mixed((prefix[k:] - prefix[:-k]) * self.inverse[: len(prefix) - k])
