"""An FM-index over word numbers: suffix array, wavelet ranks, backward search, sampled positions. All in arrays.

The text is a sequence of words 1..sigma and of separators 0. A separator sorts before every word and separators sort by
position, so no comparison of suffixes goes beyond the next separator. Patterns hold words only.
"""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Level-wise wavelet tree: ranks and access for many positions at a time."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        self.n, self.depth = len(seq), max(1, int(sigma).bit_length())
        self.words: list[np.ndarray] = []
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.depth)):
            bit = (seq >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(self.n // 64 + 1, "<u8")
            words.view(np.uint8)[: len(packed)] = packed
            self.words.append(words)
            self.ones.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.zeros.append(int(self.n - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def _rank1(self, k: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[k][word] + np.bitwise_count(self.words[k][word] & mask).astype(np.int64)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        start = np.zeros_like(at)
        for k in range(self.depth):
            one = ((symbol >> (self.depth - 1 - k)) & 1).astype(bool)
            a, s = self._rank1(k, at), self._rank1(k, start)
            at, start = np.where(one, self.zeros[k] + a, at - a), np.where(one, self.zeros[k] + s, start - s)
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the positions, and how often each stands before its own."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for k in range(self.depth):
            one = (self.words[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            a, s = self._rank1(k, at), self._rank1(k, start)
            at, start = np.where(one, self.zeros[k] + a, at - a), np.where(one, self.zeros[k] + s, start - s)
            symbol = symbol * 2 + one
        return symbol, at - start


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; after each doubling only what is still tied is sorted again."""
    n = len(seq)
    apart = seq == 0
    key = np.where(apart, np.cumsum(apart) - 1, seq.astype(np.int64) + int(apart.sum()))
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = first  # a rank is the first place of its tie group, so it never changes for what is already alone
    step = 1
    while True:
        alone = np.r_[new[1:], True] & new
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return order
        at = order[tied]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1)
        own = rank[at]
        by = np.lexsort((after, own))
        order[tied] = at[by]
        own, after = own[by], after[by]
        fresh = np.r_[True, (own[1:] != own[:-1]) | (after[1:] != after[:-1])]
        new[tied] = fresh
        rank[order[tied]] = np.maximum.accumulate(np.where(fresh, tied, 0))
        step *= 2


class FMIndex:
    """Index of one shard. `every`: distance of sampled suffix positions."""

    def __init__(self, seq: np.ndarray, sigma: int, every: int = 8) -> None:
        self.n = len(seq)
        suffixes = suffix_array(seq)
        bwt = seq[suffixes - 1]
        self.tree = WaveletTree(bwt.astype(np.int64), sigma)
        self.before = np.r_[0, np.cumsum(np.bincount(seq, minlength=sigma + 1))]
        # A walk ends at a sample. What follows a separator is sampled too: separators sort by position, not by what
        # follows them, so no walk may step onto one.
        sampled = (suffixes % every == 0) | (bwt == 0)
        self.sampled, self.position = sampled, suffixes[sampled]
        self.sample_rank = np.cumsum(sampled) - 1

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [lo, hi) of the suffixes that begin with each row; rows are right-aligned, filled with 0 on the left."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in reversed(range(patterns.shape[1])):
            live = live[(hi[live] > lo[live]) & (patterns[live, j] > 0)]
            c = patterns[live, j].astype(np.int64)
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of the suffixes at these rows."""
        out, steps, live = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        at = rows.astype(np.int64).copy()
        while len(live):
            hit = self.sampled[at]
            out[live[hit]] = self.position[self.sample_rank[at[hit]]] + steps[live[hit]]
            live, at = live[~hit], at[~hit]
            symbol, before = self.tree.access(at)
            at = self.before[symbol] + before
            steps[live] += 1
        return out
