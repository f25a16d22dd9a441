"""64-bit hashes of the words of many texts at once, from their bytes, without making words.

A word's hash is the mixed sum of one random number for each of its bytes, which depends on the byte and on its place in
the word. Two given words of the same or other lengths have equal hashes with a chance of 2^-64, whatever their letters.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
#: Bytes hashed at once; a cut is made at white space only.
PART = 1 << 22
#: Places whose random numbers are kept in a table.
PLACES = 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _random(key: np.ndarray) -> np.ndarray:
    """A random number for each key, place * 256 + byte."""
    return mixed((key.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))


_TABLE = _random(np.arange(PLACES * 256))
#: Unrelated odd factors for the words of an n-gram.
FACTORS = _random(np.arange(1 << 32, (1 << 32) + 64)) | np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 17)
        _powers[:] = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def prefix_sums(x: np.ndarray) -> np.ndarray:
    """total with which string_hash tells any x[a:b] from others.

    Sums of powers modulo 2^64 collide for some strings of two symbols that alternate by a rule. So x must be hashes of
    overlapping windows: what such a rule cancels in one place, the windows over its seams bring back.
    """
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * powers(len(x) + 1)[0][: len(x)], out=total[1:])
    return total


def string_hash(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed((total[b] - total[a]) * powers(len(total))[1][a] + (b - a).astype(np.uint64))


def ngrams(w: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = w[:n] * FACTORS[0]
    for i in range(1, k):
        out += w[i : n + i] * FACTORS[i]
    return mixed(out + np.uint64(k))


def hashed_words(texts: list[bytes], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, one text after the other, and the number of words of each. fold: A-Z as a-z."""
    buffer = b"\n".join(texts) + b"\n"
    hashes, starts, at = [], [], 0
    while at < len(buffer):
        to = at + PART
        if to < len(buffer):
            while to < len(buffer) and not _SPACE[buffer[to]]:
                to += 1
        x = np.frombuffer(buffer, np.uint8, min(to, len(buffer)) - at, at)
        inside = ~_SPACE[x]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        if len(edge) % 2:
            edge = np.concatenate([edge, [len(x)]])
        a, b = edge[::2], edge[1::2]
        if len(a):
            size = b - a
            first = np.cumsum(size) - size
            letters = x[inside]
            key = np.arange(len(letters), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
            far = np.flatnonzero(key >= PLACES) if size.max() > PLACES else ()
            key = key.astype(np.int64) << 8 | (_LOWER[letters] if fold else letters)
            if len(far):
                value = np.empty(len(key), np.uint64)
                near = np.ones(len(key), bool)
                near[far] = False
                value[near], value[far] = _TABLE[key[near]], _random(key[far])
            else:
                value = _TABLE[key]
            hashes.append(mixed(np.add.reduceat(value, first) + size.astype(np.uint64)))
            starts.append(a + at)
        at += len(x)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    place = np.searchsorted(np.concatenate(starts), begin)
    return np.concatenate(hashes), np.diff(place)
