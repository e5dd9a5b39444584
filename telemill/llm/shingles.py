"""Distinct hashed word shingles of texts, computed for many texts at once in numpy.

Words are what is left between bytes 0x20 and 0x09-0x0D after lower-casing A-Z; as UTF-8 uses none of these bytes
within a character, this works on bytes.  A word of up to 8 bytes is hashed one to one from its bytes as a number, a
longer one by xxh3; a shingle's hash is a linear form over its words' hashes, mixed again; all in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

WORDS = 5
_BASE = 0x9E6C63D0876A9A47
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_LENGTH = np.uint64(0xC2B2AE3D27D4EB4F)
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_SIZES = mix(np.arange(1, 10, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i below n, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for b in (_BASE, inverse):
            t = np.full(size, b, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if size > 1 << 23:  # for one very long text: not kept
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def lower_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' lower-cased bytes, each followed by a blank; and where each begins (with the end at last)."""
    raw = [(t or "").encode() for t in texts]
    begins = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=begins[1:])
    return _LOWER[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)], begins


def word_bounds(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside.size and inside[0]:
        edges = np.concatenate(([0], edges))
    return edges[0::2], edges[1::2]


class Prefixes:
    """Prefix sums of a buffer, from which the hash of any of its substrings takes constant time.

    As polynomials modulo 2**64 collide for some texts (whatever the base), these hashes only find candidates.
    """

    def __init__(self, buf: np.ndarray):
        self.up, self.down = _power_tables(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.up[: len(buf)], out=self.sums[1:])

    def polynomials(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the substrings from starts to ends; they depend on the bytes and the length alone."""
        return mix(self.polynomials(starts, ends) + (ends - starts).astype(np.uint64) * _LENGTH)

    def joined(self, starts: np.ndarray, ends: np.ndarray, more: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Hashes of the substrings from starts to ends followed by those from more to stops."""
        first = ends - starts
        both = self.polynomials(starts, ends) + self.polynomials(more, stops) * self.up[first]
        return mix(both + (first + stops - more).astype(np.uint64) * _LENGTH)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words from starts to ends; of words of equal length up to 8 bytes no two are equal."""
    size = ends - starts
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(buf) + 1, dtype="<u8", buffer=padded, strides=(1,))
    short = np.minimum(size, 8)
    out = mix((eight[starts] & _FIRST_BYTES[short]) ^ _SIZES[short])
    long = np.flatnonzero(size > 8)
    if len(long):
        raw = memoryview(np.ascontiguousarray(buf))
        out[long] = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64, len(long))
    return out


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles.

    A text with fewer words has one, of all its words; a null text, or one without words, has none.
    """
    if not texts:
        return
    buf, begins = lower_bytes(texts)
    starts, ends = word_bounds(_IN_WORD[buf])
    hashes = word_hashes(buf, starts, ends)
    first = np.searchsorted(starts, begins)
    factors = mix(np.arange(1, words + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    n = len(hashes)
    rolled = np.zeros(max(0, n - words + 1), dtype=np.uint64)
    for k in range(words):
        rolled += hashes[k : k + len(rolled)] * factors[k]
    rolled = mix(rolled)
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= words:
            yield np.unique(rolled[a : b - words + 1])
        elif b > a:
            yield mix((hashes[a:b] * factors[: b - a]).sum(keepdims=True) + factors[words : words + 1] * np.uint64(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)
