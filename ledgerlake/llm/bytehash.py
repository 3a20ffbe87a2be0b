"""Vectorised 64-bit hashes of byte ranges.

``RangeHash`` gives the hash of any range of a byte buffer from two prefix sums: byte ``c`` at
position ``i`` adds ``table[c] * B**i`` (mod 2**64, random table, odd ``B``); a range's sum is
divided by ``B**start``. Equal bytes give equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_POW: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche of uint64 values."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("b", ())) < n:
        n = max(n, 1 << 16)
        for key, base in (("b", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            out = np.ones(1, _U)
            while len(out) < n:
                out = np.concatenate([out, out * _U(pow(base, len(out), 1 << 64))])
            _POW[key] = out
    return _POW["b"], _POW["inv"]


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 64, 256, dtype=_U, endpoint=False)


class RangeHash:
    def __init__(self, buf: np.ndarray, seed: int = 1):
        n = len(buf)
        b, self._inv = _powers(n + 1)
        self._sum = np.zeros(n + 1, _U)
        np.cumsum(_table(seed)[buf] * b[:n], out=self._sum[1:])

    def raw(self, start, end) -> np.ndarray:
        return (self._sum[end] - self._sum[start]) * self._inv[start]

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of [start, end), the length taken in."""
        return mix(self.raw(start, end) + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))

    def grams(self, q: int) -> np.ndarray:
        """Mixed hash of every q-byte string, by start."""
        n = len(self._sum) - 1
        if n < q:
            return np.zeros(0, _U)
        return mix((self._sum[q:] - self._sum[:-q]) * self._inv[: n - q + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values, by doubling."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    if size < width:
        x = np.minimum(x[: len(x) - (width - size)], x[width - size :])
    return x
