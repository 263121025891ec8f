"""Hashes of many substrings of a byte string at once, by prefix sums of a polynomial modulo 2^64."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """At least ``n`` powers of ``base``; tables come in sizes of powers of two and stay in the worker."""
    bits = max(16, int(n - 1).bit_length())
    if (base, bits) not in _POWERS:
        out = np.full(1 << bits, base, dtype=np.uint64)
        out[0] = 1
        _POWERS[base, bits] = np.multiply.accumulate(out)
    return _POWERS[base, bits]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """``sums[i]``: the polynomial of the first ``i`` bytes (each plus one, so that zero bytes count)."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data))[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each substring [start, end), equal for equal substrings wherever they lie."""
    return mixed((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start])
