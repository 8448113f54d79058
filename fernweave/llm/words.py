"""Words and word n-grams of many texts at once, in numpy.

Words are runs of bytes other than space and 9 to 13. A word's value is a 64-bit hash of its bytes and their places,
read off running sums, so no word is handled by itself.
"""

from __future__ import annotations

from functools import cache

import numpy as np

U = np.uint64
STEP = U(0x9E3779B97F4A7C15)
BASE = 0x9FB21C651E98DF25 | 1


@cache
def signs() -> np.ndarray:
    """A random value for each byte."""
    return np.random.default_rng(20240101).integers(0, 1 << 64, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum over a word's bytes of a mixed value of byte and place in the word, so words that differ in any way have
    unrelated hashes, however long or regular they are."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # place in the word
    inside = data[at + np.repeat(starts, sizes)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(signs()[inside] + at.astype(np.uint64) * STEP))])
    edge = np.cumsum(sizes)
    return mix(sums[edge] - sums[edge - sizes] + sizes.astype(np.uint64) * STEP)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row; empty where there are fewer."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = (out + words[k : k + m]) * U(BASE)
        out ^= out >> U(29)
    return mix(out)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A copy with A to Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


class Texts:
    """Words of a list of UTF-8 texts: hashes of all words in a row, and the word number where each text begins."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = np.frombuffer(b" ".join(texts), np.uint8)
        if lower:
            data = lower_ascii(data)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.concatenate(([0], np.cumsum(sizes + 1)))
        self.starts, self.ends = word_bounds(data)
        self.hashes = word_hashes(data, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, begins)
        self.data = data

    def of(self, k: int) -> np.ndarray:
        return self.hashes[self.first[k] : self.first[k + 1]]
