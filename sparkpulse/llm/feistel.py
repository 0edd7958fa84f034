"""Keyed pseudorandom permutations of {0 .. n-1}: a balanced Feistel network over the next even number of bits, with cycle-walking."""

from __future__ import annotations

import hashlib

import numpy as np

ROUNDS = 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(key: str, *parts: np.ndarray) -> np.ndarray:
    """64-bit keys, one for each row of parts, under a key: for many permutations at once."""
    x = np.full(1, int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "little"), np.uint64)
    for p in parts:
        x = _mix(x ^ _mix(np.asarray(p).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return x


def permute(index: np.ndarray, n: int | np.ndarray, key: str | np.ndarray) -> np.ndarray:
    """Slots of the indexes under the key.  n is one size, or one for each index; every index must be below its n.
    key is one text, or a 64-bit number for each index (``seeds``).

    A value that leaves the domain is permuted again until it is back inside (cycle-walking), so the result is a
    bijection for any n.  The domain is less than four times n, hence some walks, each halving at least what is left.
    """
    x = np.asarray(index, np.uint64).copy()
    size = np.broadcast_to(np.asarray(n, np.uint64), x.shape)
    if x.size and bool((x >= size).any()):
        raise ValueError("an index lies outside its domain")
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(size.astype(np.float64), 2.0)) / 2).astype(np.uint64))
    bits = bits + (np.uint64(2) * bits < np.uint64(63)) * ((np.uint64(1) << (np.uint64(2) * bits)) < size).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    if isinstance(key, str):
        digest = hashlib.sha256(key.encode()).digest()
        keys = [np.full(x.size, int.from_bytes(hashlib.sha256(digest + bytes([r])).digest()[:8], "little"), np.uint64) for r in range(ROUNDS)]
    else:
        keys = [_mix(key ^ _mix(np.full(1, r + 1, np.uint64))) for r in range(ROUNDS)]
    todo = np.arange(x.size)
    while todo.size:
        v, b, m = x[todo], bits[todo], mask[todo]
        left, right = v >> b, v & m
        for k in keys:
            left, right = right, left ^ (_mix(right + k[todo]) & m)
        x[todo] = v = (left << b) | right
        todo = todo[v >= size[todo]]
    return x.astype(np.int64)
