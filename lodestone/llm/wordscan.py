"""Words of UTF-8 buffers and their 64-bit hashes, whole buffers at a time.

A word is a maximal run of bytes other than space and \\x09-\\x0D; no multi-byte
character holds such a byte, so bytes and characters give the same words.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHINGLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in data, and the index of the first word of each row (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    inner = offs[(offs > 0) & (offs < len(data))]
    start[inner] = solid[inner]
    end[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), np.uint64)
    lens = ends - starts
    before = np.concatenate(([0], np.cumsum(lens)))
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(before, before[a] + piece, "right")) - 1)
        n, first = lens[a:b], before[a:b] - before[a]
        place = np.arange(before[b] - before[a]) - np.repeat(first, n)
        v = _BYTE[data[np.repeat(starts[a:b], n) + place]]
        v *= _PLACE[place & 0xFFFF]
        out[a:b] = np.add.reduceat(v, first) + n.astype(np.uint64) * _LENGTH
        a = b
    return mix(out)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; rows' bounds are the caller's matter."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * SHINGLE[j]
    return mix(out + np.uint64(k))


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence of any length."""
    place = _PLACE[np.arange(len(h)) & 0xFFFF]
    return mix((h * place).sum(keepdims=True) + np.array([len(h)], np.uint64) * _LENGTH)[0]
