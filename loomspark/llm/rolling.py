"""Polynomial hashes of any substring, for a whole buffer at once.

prefix[i] sums table[byte k] * BASE**k over k < i, modulo 2**64; the hash of [a, b) is
(prefix[b] - prefix[a]) * BASE**-a, then mixed. Bytes are spread by a random table first, so the low
bits are as good as the high ones. One pass costs a few nanoseconds a byte.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20240917))
TABLE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class Powers:
    """Tables of BASE**k and BASE**-k that grow as longer buffers come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(1 << 16, 1 << int(n).bit_length())
            self.up, self.down = _powers(BASE, size), _powers(_INVERSE, size)


POWERS = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of substrings of one buffer."""

    def __init__(self, data: np.ndarray, table: np.ndarray = TABLE):
        POWERS.upto(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * POWERS.up[: len(data)], out=self.prefix[1:])

    def raw(self, start: np.ndarray | int, end: np.ndarray | int) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * POWERS.down[start]

    def windows(self, size: int) -> np.ndarray:
        """Of every substring of ``size`` bytes."""
        n = len(self.prefix) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return (self.prefix[size:] - self.prefix[:n]) * POWERS.down[:n]


def chunks(offsets: np.ndarray, limit: int = 1 << 20):
    """Ranges (first, last) of whole documents of about ``limit`` bytes together; a longer document is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)
