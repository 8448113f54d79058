"""A compressed FM-index over an integer text, for patterns up to a fixed depth.

Suffixes are sorted by their first `depth` symbols or more (prefix doubling); that is enough for backward search of
patterns up to that length. What is kept is the Burrows-Wheeler transform in a wavelet matrix of packed bits with counts,
and a bit for each suffix that differs from the one before it within `depth` symbols; the suffix array goes once these
are built. The bits give, for any suffix, the interval of those that start with the same `depth` symbols, which is what
matching statistics need to drop the last symbol of a match that was extended at its front.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)
END = 1  # the symbol that ends a part


def sorted_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): the suffixes by their first symbols, at least `depth` of them, and how many of those each shares
    with the one before it, up to `depth`. Every END is a symbol of its own, by place, so nothing is equal past one."""
    n, ends = len(text), np.flatnonzero(text == END)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    ranks, k = [], 1
    order = np.argsort(rank, kind="stable")
    while True:
        s = rank[order]
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(np.concatenate(([False], s[1:] != s[:-1])))
        ranks.append((k, dense))
        if k >= depth:
            break
        rank = dense * (n + 1)
        rank[: n - k] += dense[k:] + 1
        order = np.argsort(rank, kind="stable")
        k *= 2
    shared = np.zeros(n, np.int64)
    before, own = order[:-1].copy(), order[1:].copy()
    for k, dense in reversed(ranks):
        same = dense[np.minimum(before, n - 1)] == dense[np.minimum(own, n - 1)]
        shared[1:] += k * same
        before += k * same
        own += k * same
    return order, np.minimum(shared, depth)


class RankBits:
    """A packed bit vector that counts the ones before a position."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.uint32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        k = at >> 6
        part = self.words[k] & ((ONE << (at & 63).astype(np.uint64)) - ONE)
        return self.before[k].astype(np.int64) + np.bitwise_count(part)


class FMIndex:
    """text: symbols from 2, and END after every part; patterns don't contain END."""

    def __init__(self, text: np.ndarray, depth: int):
        text = np.asarray(text, np.int64)
        order, shared = sorted_suffixes(text, depth)
        self.depth, self.size = depth, len(text)
        counts = np.bincount(text, minlength=2)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        bwt = text[order - 1]
        self.levels = []
        for bit in range(max(1, int(len(counts) - 1).bit_length()) - 1, -1, -1):
            bits = (bwt >> bit) & 1
            self.levels.append((bit, RankBits(bits), int(len(bits) - bits.sum())))
            bwt = np.concatenate([bwt[bits == 0], bwt[bits == 1]])
        symbols = np.arange(len(counts))
        self.base = self.down(symbols, [np.zeros(len(counts), np.int64)])[0]
        differs = shared < depth
        self.differs = RankBits(differs)
        self.borders = np.append(np.flatnonzero(differs), len(text)).astype(np.int32)

    def down(self, symbol: np.ndarray, places: list[np.ndarray]) -> list[np.ndarray]:
        """Places of the transform followed to the symbols' places in the last level."""
        for bit, ranks, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            ones = [ranks.ones(p) for p in places]
            places = [np.where(one, zeros + r, p - r) for p, r in zip(places, ones, strict=True)]
        return places

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that start with a symbol and go on as those of [low, high)."""
        a, b = self.down(symbol, [low, high])
        start = self.first[symbol] - self.base[symbol]
        return start + a, start + b

    def widened(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that share their first `depth` symbols with the one at low."""
        k = self.differs.ones(low + 1)
        return self.borders[k - 1].astype(np.int64), self.borders[k].astype(np.int64)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the rows of a matrix of patterns by backward search; one that is down to a single place is given
        up, since it stands nowhere else: high <= low + 1."""
        last = patterns[:, -1]
        low, high = self.first[last].copy(), self.first[last + 1].copy()
        for k in range(patterns.shape[1] - 2, -1, -1):
            go = np.flatnonzero(high > low + 1)
            if not len(go):
                break
            low[go], high[go] = self.extend(patterns[go, k], low[go], high[go])
        return low, high

    def matches(self, symbols: np.ndarray, first: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Matching statistics of texts that are streamed against the index, up to `depth`: for each window of `depth` symbols
        the start of its interval, or -1 where it stands at no two places. Text k has its first window at first[k] and
        windows[k] of them. All texts go from back to front at once: a match is extended by the symbol before it and cut
        back to `depth`; where that fails, the window is searched afresh."""
        base = np.cumsum(windows) - windows
        out = np.full(int(windows.sum()), -1, np.int64)
        low, high = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        span = np.arange(self.depth)
        for back in range(1, int(windows.max(initial=0)) + 1):
            live = np.flatnonzero(windows >= back)
            at = first[live] + windows[live] - back
            a, b = low[live], high[live]
            on = np.flatnonzero(b > a + 1)
            if len(on):
                x, y = self.extend(symbols[at[on]], a[on], b[on])
                a[on], b[on] = x, y
                go = on[y > x + 1]
                a[go], b[go] = self.widened(a[go])
            anew = np.flatnonzero(b <= a + 1)
            if len(anew):
                a[anew], b[anew] = self.search(symbols[at[anew, None] + span])
            low[live], high[live] = a, b
            out[base[live] + windows[live] - back] = np.where(b > a + 1, a, -1)
        return out
