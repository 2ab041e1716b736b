"""Polynomial fingerprints of all windows of a sequence, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MASK = 2 ** 64 - 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, _MASK + 1))):
            steps = np.full(size, np.uint64(base), dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def spread(values: np.ndarray) -> np.ndarray:
    """Mixes 64-bit numbers so that all bits depend on all bits."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


#: a random odd number for each byte value
BYTE_VALUES = spread(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def window_hashes(values: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
    """Fingerprints of the windows of ``width`` values that start at ``at`` (all by default).

    Equal windows have equal fingerprints wherever they stand.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(len(values))
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.multiply(values, down, out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    # the base's powers sink with the position; raising by the mirrored power levels them
    if at is None:
        found = sums[width:] - sums[:n]
        found *= up[:n]
    else:
        found = (sums[at + width] - sums[at]) * up[at]
    return spread(found)
