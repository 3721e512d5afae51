"""Word shingles of texts as sorted arrays of 64-bit hashes, whole batches at a time.

Words are what ``[^\\x20\\x09-\\x0D]+`` matches after A-Z are lower-cased.  A word's
hash is a polynomial over its bytes, read off prefix sums of the whole batch; a
shingle's hash mixes the hashes of its words.  A text with fewer words than a
shingle is one shingle; one without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

WORDS = 5
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes, lower case, white space, odd multipliers of the words of a shingle."""
    rng = np.random.default_rng(5)
    values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    values = values * np.uint64(2) + np.uint64(1)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    blank = np.zeros(256, bool)
    blank[[32, *range(9, 14)]] = True
    factors = rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return values[lower], lower, blank, factors


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        have = np.full(size, np.uint64(base), np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(code: np.ndarray, begins: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """64-bit hashes of spans of bytes, by one of two independent polynomials."""
    base = (_BASE, 0xD6E8FEB86659FD93)[which]
    values = _tables()[0] if which == 0 else np.random.default_rng(which).integers(1, 1 << 63, 256, dtype=np.uint64)
    # Case is kept here: of the values above, capitals have those of small letters.
    values = values.copy()
    values[65:91] = np.random.default_rng(7 + which).integers(1, 1 << 63, 26, dtype=np.uint64)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(values[code] * _power(base, len(code)), out=sums[1:])
    return mix((sums[ends] - sums[begins]) * _power(pow(base, -1, 1 << 64), len(code))[begins])


def word_hashes(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of concatenated texts, and the n + 1 offsets of the texts' words."""
    values, _, blank, _ = _tables()
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    space = blank[b]
    edge = np.empty(n + 1, bool)  # before each byte: blank or the edge of a text
    edge[1:] = space
    edge[at] = True
    starts = np.flatnonzero(edge[:-1] & ~space)
    edge[:-1] = space
    edge[at] = True
    ends = np.flatnonzero(edge[1:] & ~space) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[b] * _power(_BASE, n), out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * _power(_INVERSE, n)[starts])
    return words, np.searchsorted(starts, at)


def shingle_sets(data: bytes, at: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    factors = _tables()[3]
    words, of = word_hashes(data, at)
    count = len(words) - WORDS + 1
    if count > 0:
        mixed = words[:count] * factors[0]
        for j in range(1, WORDS):
            mixed += words[j : j + count] * factors[j]
        mixed = mix(mixed)
    cuts = of.tolist()
    for a, b in zip(cuts, cuts[1:]):
        if b - a >= WORDS:
            yield np.unique(mixed[a : b - WORDS + 1])
        elif b > a:
            yield mix((words[a:b] * factors[: b - a]).sum(keepdims=True) + factors[WORDS + b - a])
        else:
            yield np.empty(0, np.uint64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0
