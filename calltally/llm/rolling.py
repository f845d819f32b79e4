"""Rolling hashes over the words of many texts at once, and packed exchanges of sorted hash lists.

Words are maximal runs without the white space ``[\\x20\\x09-\\x0D]``. A word's hash and a window's hash are polynomials
modulo 2**64 with random coefficients, taken from prefix sums (so a window costs the same at any width) and mixed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import flat

U = np.uint64
CHUNK = 1 << 20  # bytes of text whose byte-level arrays are held at once (or one text, if longer)

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_STEPS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F)  # odd, so they have inverses


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=16)
def _table(step: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, step, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _powers(step: int, n: int) -> np.ndarray:
    return _table(step, max(16, (n + 1).bit_length()))[: n + 1]


def _inverses(step: int, n: int) -> np.ndarray:
    return _powers(pow(step, -1, 1 << 64), n)


class Words:
    """Words of a column of texts: ``first[d]`` is the index of text d's first word, ``h`` the words' hashes."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = False):
        data, offsets = flat(column)
        n = len(offsets) - 1
        counts, hashes = np.zeros(n, np.int64), []
        d = 0
        while d < n:
            e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + CHUNK, "right")) - 1)
            part = data[offsets[d] : offsets[e]]
            at = offsets[d : e + 1] - offsets[d]
            h, first = _word_hashes(_LOWER[part] if lower else part, at)
            counts[d:e] = np.diff(first)
            hashes.append(h)
            d = e
        self.h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.counts = counts

    def last(self) -> np.ndarray:
        """For each word, the index one past its text's last word."""
        return np.repeat(self.first[1:], self.counts)

    def sums(self, which: int = 0) -> tuple[np.ndarray, int]:
        """Prefix sums for ``windows``."""
        step = _STEPS[1 + which]
        h = mix(self.h ^ U(which)) if which else self.h
        c = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * _powers(step, len(h))[: len(h)], out=c[1:])
        return c, step


def windows(sums: tuple[np.ndarray, int], starts: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of so many words at ``starts``."""
    c, step = sums
    return mix((c[starts + width] - c[starts]) * _inverses(step, len(c))[starts])


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    white = _WHITE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts, ends = ~white, ~white
    starts[1:] &= white[:-1] | cut[1:n]
    ends[:-1] &= white[1:] | cut[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(_STEPS[0], n)[:n], out=c[1:])
    h = mix((c[e] - c[s]) * _inverses(_STEPS[0], n)[s] + (e - s).astype(np.uint64))
    return h, np.searchsorted(s, offsets)


def edges(n: int, bits: int) -> np.ndarray:
    """Lower ends of ``n`` equal ranges of numbers of so many bits, and the upper end of the last (as near as 64 bits go)."""
    return np.array([min((k << bits) // n, (1 << 64) - 1) for k in range(n + 1)], np.uint64)


def cut_points(ordered: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the ranges start in an ordered list (one more than ranges)."""
    at = np.searchsorted(ordered, ends)
    at[-1] = len(ordered)
    return at


def encode(ordered: np.ndarray) -> bytes:
    """A sorted list of numbers as differences, low bytes first, in as many planes as the largest needs."""
    if len(ordered) == 0:
        return b""
    d = np.diff(ordered, prepend=U(0))
    width = max(1, (int(d[1:].max()).bit_length() + 7) // 8) if len(d) > 1 else 1
    planes = d[1:].view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + ordered[:1].tobytes() + planes.tobytes()


def decode(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width, n = blob[0], (len(blob) - 9) // blob[0]
    d = np.zeros((n + 1, 8), np.uint8)
    d[0] = np.frombuffer(blob, np.uint8, 8, 1)
    if n:
        d[1:, :width] = np.frombuffer(blob, np.uint8, n * width, 9).reshape(width, n).T
    return np.cumsum(d.view(np.uint64).ravel())


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)
