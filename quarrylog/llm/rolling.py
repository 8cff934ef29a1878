"""Prefix polynomial hashes over bytes, modulo 2**64."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


class Hasher:
    """Hashes of any substring of a buffer after one pass over it; powers are kept and grown as needed."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """``prefix[i]`` hashes the first ``i`` bytes of ``data``."""
        n = len(data) + 1
        if len(self.powers) < n:
            size = max(n, 1 << 16)
            self.powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, _BASE))))
            self.inverses = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, _INVERSE))))
        out = np.empty(n, np.uint64)
        out[0] = 0
        np.cumsum(_BYTES[data] * self.powers[: n - 1], out=out[1:])
        return out

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Mixed hash of the ``k`` bytes from every position."""
        return mixed((prefix[k:] - prefix[:-k]) * self.inverses[: len(prefix) - k])

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of ``start[i]:end[i]``; equal strings have equal hashes wherever they stand."""
        return (prefix[end] - prefix[start]) * self.inverses[start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h
