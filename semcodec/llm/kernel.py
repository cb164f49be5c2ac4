"""Vectorised word and shingle hashing over many texts at once, on UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE_CODE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Odd factors for the places of a window of words.
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_lower = np.arange(256)
_lower[65:91] += 32
_LOWER_CODE = _BYTE_CODE[_lower]

#: Bytes of words: all but space and \t \n \v \f \r; and digits, letters and non-ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(n, np.uint64(base), np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all texts, and for each text where its words begin in those."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = table[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    here, before = inside[1:-1], inside[:-2]
    starts = np.flatnonzero(here & (~before | cut[:-1]))
    ends = np.flatnonzero(here & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; lower: A-Z count as a-z."""
    up, down = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_LOWER_CODE if lower else _BYTE_CODE)[buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of `width` words within texts, the first word of each, and where each text's windows begin."""
    n = np.diff(first)
    count = np.maximum(n - width + 1, 0)
    begins = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=begins[1:])
    at = np.arange(begins[-1]) + np.repeat(first[:-1] - begins[:-1], count)
    sums = np.zeros(len(at), np.uint64)
    for k in range(width):
        sums += words[at + k] * _PLACE[k]
    return mix(sums), at, begins
