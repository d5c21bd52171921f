"""Hashes of words in numpy, for whole texts at a time."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd: it has an inverse modulo 2**64
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each word: differences of one prefix hash, shifted to a common origin."""
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_STEP, len(data)), out=prefix[1:])
    back = _powers(_BACK, len(data) + 1)
    return (prefix[end] - prefix[start]) * back[start] ^ (end - start).astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes with well-spread bits, one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
