"""Vectorised 64-bit hashes of words and of substrings, for use inside tasks."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _table() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64)
    return mix(mix(x, 11), 12) | np.uint64(1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; equal inputs and seeds give equal outputs."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTES = _table()
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]


class Rolling:
    """Polynomial hashes of substrings of a buffer, modulo 2**64; the powers are made once and grow."""

    powers = np.ones(1, np.uint64)
    inverse = np.ones(1, np.uint64)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls.powers) < n:
            n = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                for name, base in (("powers", _BASE), ("inverse", _INVERSE)):
                    x = np.full(n, base, np.uint64)
                    x[0] = 1
                    setattr(cls, name, np.cumprod(x, dtype=np.uint64))

    def __init__(self, buffer: np.ndarray, lower: bool = False):
        n = len(buffer)
        self._grow(n + 1)
        with np.errstate(over="ignore"):
            self.sums = np.empty(n + 1, np.uint64)
            self.sums[0] = 0
            x = (_LOWER if lower else _BYTES)[buffer]
            x *= self.powers[:n]
            np.cumsum(x, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of buffer[start:end]; equal bytes give equal hashes wherever they lie."""
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all substrings of k bytes, unmixed."""
        with np.errstate(over="ignore"):
            x = self.sums[k:] - self.sums[:-k]
            x *= self.inverse[: len(x)]
            return x


def words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Words between ASCII white space: hash, start and end of every word, words of each text, and the buffer.

    With `lower`, A-Z hash as a-z.
    """
    joined = b"\n".join(texts)
    buffer = np.frombuffer(joined, np.uint8)
    space = np.ones(len(buffer) + 2, bool)
    space[1:-1] = _SPACE[buffer]
    edges = np.flatnonzero(space[1:] != space[:-1])
    start, end = edges[::2], edges[1::2]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    count = np.diff(np.searchsorted(start, cuts))
    return Rolling(buffer, lower).of(start, end), start, end, count, joined
