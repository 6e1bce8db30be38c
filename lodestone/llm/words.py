"""Words and their hashes over whole Arrow buffers, a few numpy passes each.

A word's hash is a polynomial in its bytes modulo 2**64, taken from one running sum over the buffer and mixed.
"""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: After lower-casing A-Z: runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F], bytes of longer characters included.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Runs of [^\x20\x09-\x0D].
SOLID = np.ones(256, bool)
SOLID[9:14] = SOLID[32] = False

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(name: str, base: int, n: int) -> np.ndarray:
    held = _POWERS.get(name)
    if held is None or len(held) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        held = np.full(size, base, np.uint64)
        held[0] = 1
        held = np.cumprod(held, dtype=np.uint64)
        if size <= 1 << 22:  # kept only for usual sizes
            _POWERS[name] = held
    return held


def bounds(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in the joined texts; a text's edge ends a word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = solid[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[0] = after[-1] = False
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data) + 1
    powers, back = _powers("forward", _BASE, n), _powers("back", pow(_BASE, -1, 1 << 64), n)
    total = np.zeros(n, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: n - 1], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, and where each text's words begin among them (one more entry than texts)."""
    low = LOWER[data]
    starts, ends = bounds(low, offsets, solid)
    return hashes(low, starts, ends), np.searchsorted(starts, offsets)


def grams(hashed: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of k words from each place (or from each of `at`) on, in that order; places whose k words do not exist are left out."""
    n = len(hashed) - k + 1
    if at is None:
        if n <= 0:
            return np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total = total * np.uint64(_BASE) + hashed[j : j + n]
    else:
        total = np.zeros(len(at), np.uint64)
        for j in range(k):
            total = total * np.uint64(_BASE) + hashed[at + j]
    return mix(total + np.uint64(k))


def owner(begins: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(begins) - 1), np.diff(begins))
