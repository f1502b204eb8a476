"""Words of many texts at once, as 64-bit hashes, in numpy.

A word's hash is a polynomial over random 64-bit values of its bytes, modulo 2**64, then mixed; every word of a
buffer comes from one cumulative sum. Two given words collide with a probability near 2**-58.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_P = U(0x9E3779B97F4A7C15 | 5)  # odd, 5 modulo 8: its powers repeat as late as any
_P_INV = U(pow(int(_P), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pair(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of ordered pairs."""
    return mix(a * U(0xD6E8FEB86659FD93) + mix(b + U((0x2545F4914F6CDD1D + salt) % (1 << 64))))


_BYTES = mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTES_FOLDED = _BYTES[_FOLD]

#: Separators of `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_powers = [np.ones(1, U), np.ones(1, U)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, p in enumerate((_P, _P_INV)):
            steps = np.full(size, p, U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the offsets of each text's words. Words never cross texts."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = edge[:n].copy()
    before[1:] |= ~inside[:-1]
    after = edge[1:].copy()
    after[:-1] |= ~inside[1:]
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """Hashes of the words; with ``fold`` A-Z count as a-z."""
    if len(starts) == 0:
        return np.zeros(0, U)
    up, down = _pow(len(data))
    sums = (_BYTES_FOLDED if fold else _BYTES)[data]
    sums *= up
    np.cumsum(sums, out=sums)
    total = sums[ends - 1]
    total -= np.where(starts > 0, sums[np.maximum(starts, 1) - 1], U(0))
    return mix(total * down[starts])


def rolling(data: np.ndarray):
    """``hashes`` of spans of the same buffer, many times, without folding."""
    up, down = _pow(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTES[data] * up, out=sums[1:])
    return lambda starts, ends: mix((sums[ends] - sums[starts]) * down[starts])


def words(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts and the offsets of each text's words."""
    starts, ends, bounds = spans(data, offsets)
    return hashes(data, starts, ends, fold), bounds


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text's number for each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def bucket(h: np.ndarray, n: int) -> np.ndarray:
    """The shard of each hash, by its highest bits."""
    return (((h >> U(32)) * U(n)) >> U(32)).astype(np.int64)


def split(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Offsets of the n shards in a sorted array of hashes."""
    return np.searchsorted(bucket(sorted_hashes, n), np.arange(n + 1))


def first_of_runs(values: np.ndarray) -> np.ndarray:
    """True where a new run of equal values begins."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return new
