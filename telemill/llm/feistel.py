"""Keyed permutations of 0..n-1: balanced Feistel networks over the next even power of two, with cycle walking.

A Feistel network permutes 2**(2w) numbers whatever its round function.  A value that leaves 0..n-1 is permuted again
until it comes back ("cycle walking"), which makes the restriction to 0..n-1 a permutation too; as the domain is less
than four times n (for n > 1), fewer than four steps are expected.
"""

from __future__ import annotations

import hashlib

import numpy as np

_GOLDEN = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class ArrayPermutation:
    """Permutes whole uint64 arrays over 0..n-1 (n up to 2**62); the same n and seed give the same order everywhere."""

    def __init__(self, n: int, seed: int, rounds: int = 6):
        if not 0 <= n <= 1 << 62:
            raise ValueError("n must be within 0..2**62")
        self.n, self.w = n, half_bits(n)
        self.keys = [np.uint64(((seed + 1) * _GOLDEN * (2 * r + 1) + r) & _M64) for r in range(rounds)]
        self.mask = np.uint64((1 << self.w) - 1)

    def _once(self, x: np.ndarray) -> np.ndarray:
        shift = np.uint64(self.w)
        left, right = x >> shift, x & self.mask
        with np.errstate(over="ignore"):
            for k in self.keys:
                left, right = right, left ^ (_mix(right + k) & self.mask)
        return (left << shift) | right

    def __call__(self, values) -> np.ndarray:
        out = self._once(np.asarray(values, dtype=np.uint64))
        while (away := np.flatnonzero(out >= np.uint64(self.n))).size:
            out[away] = self._once(out[away])
        return out.astype(np.int64)


class KeyedPermutation:
    """Permutes single integers over 0..n-1 under a secret key and a tweak; n is arbitrary."""

    def __init__(self, n: int, key: bytes, tweak: str, rounds: int = 8):
        self.n, self.w, self.rounds = n, half_bits(n), rounds
        self.bytes = max(20, (self.w + 7) // 8)
        size = max(40, (n.bit_length() + 7) // 8)
        self.base = hashlib.blake2b(tweak.encode() + n.to_bytes(size, "little"), key=key[:64], digest_size=32).digest()

    def _round(self, r: int, half: int) -> int:
        raw = hashlib.blake2b(half.to_bytes(self.bytes, "little"), key=self.base, salt=bytes([r]), digest_size=min(self.bytes, 64)).digest()
        if self.bytes > 64:
            raw = hashlib.shake_256(raw).digest(self.bytes)
        return int.from_bytes(raw, "little") & ((1 << self.w) - 1)

    def _once(self, x: int, order) -> int:
        left, right = x >> self.w, x & ((1 << self.w) - 1)
        for r in order:
            left, right = right, left ^ self._round(r, right)
        return (left << self.w) | right

    def __call__(self, x: int) -> int:
        x = self._once(x, range(self.rounds))
        while x >= self.n:
            x = self._once(x, range(self.rounds))
        return x

    def invert(self, x: int) -> int:
        def back(y: int) -> int:
            swap = lambda z: ((z & ((1 << self.w) - 1)) << self.w) | (z >> self.w)
            return swap(self._once(swap(y), range(self.rounds - 1, -1, -1)))

        x = back(x)
        while x >= self.n:
            x = back(x)
        return x
