"""Hashes of words and of stretches of words, for many texts at once.

A word has its XXH64. A stretch has a polynomial in an odd base, modulo 2**64, over the hashes of its words: prefix sums
give its value by one subtraction and one product with the base's inverse power. mix() spreads the bits.
"""

from __future__ import annotations

import itertools

import numpy as np

_BASES = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0676A9A99))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)
_TABLES: dict[int, np.ndarray] = {}
#: Words whose hash a worker keeps.
HELD = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, inverse: bool = False, other: bool = False) -> np.ndarray:
    """base**0 to base**(n-1), kept and extended as needed."""
    kind = 2 * other + inverse
    table = _TABLES.get(kind, np.empty(0, np.uint64))
    if len(table) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, (_INVERSES if inverse else _BASES)[other])
        steps[0] = 1
        table = np.cumprod(steps, dtype=np.uint64)
        if size <= 1 << 22:
            _TABLES[kind] = table
    return table[:n]


def prefixes(values: np.ndarray, other: bool = False) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(len(values), other=other), dtype=np.uint64)])


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, other: bool = False) -> np.ndarray:
    """The polynomial of values[start:end], wherever it stands."""
    return (sums[end] - sums[start]) * powers(len(sums), inverse=True, other=other)[start]


class Hashes(dict):
    """A word to its XXH64, kept for the words met; one that is full is emptied."""

    def __init__(self, seed: int):
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= HELD:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value


#: One table for each of two independent hashes, kept by a worker between its tasks.
_WORDS = (Hashes(0), Hashes(0x9E3779B97F4A7C15))


class Words:
    """The words of some texts (bytes): a hash of each word, first word and count of each text."""

    def __init__(self, texts: list[bytes], other: bool = False):
        split = [t.split() for t in texts]
        self.count = np.fromiter(map(len, split), np.int64, len(split))
        self.hash = np.fromiter(map(_WORDS[other].__getitem__, itertools.chain.from_iterable(split)), np.uint64, int(self.count.sum()))
        self.doc = np.repeat(np.arange(len(split)), self.count)
        self.first = np.cumsum(self.count) - self.count
