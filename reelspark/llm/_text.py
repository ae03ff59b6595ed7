r"""Vectorised hashing of words and windows in UTF-8 bytes.

A word's hash is a polynomial in its bytes modulo 2**64, got from prefix sums over the whole text and shifted to
position 0 by the inverse of the (odd) base, then mixed. It depends on the word only.
"""

from __future__ import annotations

import numpy as np

BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16, 2 * len(_powers[0]))
        for i, b in enumerate((BASE, INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums for ``span_hash``."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][: len(data)], out=c[1:])
    return c


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    inv = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(text: bytes) -> np.ndarray:
    """The hash of each word, in order."""
    data = np.frombuffer(text, np.uint8)
    return span_hash(prefix(data), *runs(~SPACE[data]))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words; of all words together if there are fewer; nothing without words."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : n - k + 1 + j])
    return h
