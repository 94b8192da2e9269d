"""Substring dedup with a compressed FM-index per shard.

The index of a shard is the Burrows-Wheeler transform of its segments in a wavelet matrix: one bit vector a level, in packed
words with counts every 64 bits. Documents' segments stream through it by backward search, all at once: a match grows to the
left as long as it occurs twice; where it stops, the search begins anew one word further left. Windows inside a match of at
least the threshold are reported.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from lattica.llm.repeats import remove_repeats
from lattica.llm.text import U

#: Words of a repeated window; words of the minimiser that deals segments to shards.
LENGTH, ANCHOR = 35, 8


class WaveletMatrix:
    """Rank queries over a sequence of small integers."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.n, self.levels = len(values), max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        now = values
        for level in range(self.levels - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            raw = np.packbits(bit, bitorder="little")
            packed = np.zeros(self.n // 64 + 1, dtype=np.uint64)
            packed.view(np.uint8)[: len(raw)] = raw
            counts = np.zeros(len(packed) + 1, dtype=np.uint32)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            self.words.append(packed)
            self.counts.append(counts)
            self.zeros.append(self.n - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def range(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the symbol at both ends of a range at once; starts: where each symbol's block begins at the last level."""
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self._ones(i, lo), self._ones(i, hi)
            z = self.zeros[i]
            lo, hi = np.where(one, z + a, lo - a), np.where(one, z + b, hi - b)
        return lo - starts[symbol], hi - starts[symbol]

    def _ones(self, i: int, at: np.ndarray) -> np.ndarray:
        w = at >> 6
        return self.counts[i][w].astype(np.int64) + np.bitwise_count(self.words[i][w] & ((U(1) << (at & 63).astype(np.uint64)) - U(1)))


class FMIndex:
    """Over sequences of integers from 1; each sequence ends with a mark of its own."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, n: np.ndarray, sigma: int):
        total = int(n.sum()) + len(n)
        ends = np.cumsum(n + 1) - 1
        text = np.zeros(total, dtype=np.int64)
        body = np.ones(total, dtype=bool)
        body[ends] = False
        text[body] = symbols
        order = self._sort(text, ends, int((n + 1).max()))
        bwt = text[order - 1]
        self.matrix = WaveletMatrix(bwt, sigma + 1)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        # a symbol's place at the last level, where symbols stand by their reversed bits
        self.places = self.matrix.range(np.arange(sigma + 1), np.zeros(sigma + 1, dtype=np.int64), np.zeros(sigma + 1, dtype=np.int64), np.zeros(sigma + 1, dtype=np.int64))[0]
        self.n = total

    @staticmethod
    def _sort(text: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
        """Suffix order by prefix doubling; marks differ from one another, so suffixes need not be compared beyond them."""
        rank = text + len(ends)
        rank[ends] = np.arange(len(ends))
        step = 1
        while True:
            follow = np.full(len(rank), 0, dtype=np.int64)
            follow[:-step] = rank[step:] + 1
            order = np.argsort(rank * (int(rank.max()) + 2) + follow)
            a, b = rank[order], follow[order]
            new = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
            rank = np.empty_like(rank)
            rank[order] = new
            step *= 2
            if step > longest or new[-1] == len(rank) - 1:
                return order

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with the symbol before those of the ranges given."""
        a, b = self.matrix.range(symbol, lo, hi, self.places)
        return self.below[symbol] + a, self.below[symbol] + b


def matching_windows(words, first, n, before, group, length, k, again, offsets) -> None:
    """Marks windows of the segments that occur twice in the shard, by backward search for all segments in step."""
    spots = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    codes, symbols = np.unique(words[spots], return_inverse=True)
    symbols = symbols.astype(np.int64) + 1
    index = FMIndex(symbols, first, n, len(codes))
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    who = np.arange(len(n))
    end = n - 1  # last word of the match
    at = end.copy()  # next word to take
    lo, hi = np.zeros(len(n), dtype=np.int64), np.full(len(n), index.n, dtype=np.int64)
    while len(who):
        lo, hi = index.extend(symbols[begin[who] + at], lo, hi)
        twice = hi - lo > 1
        full = twice & (end - at + 1 >= length)
        again[offsets[who[full]] + at[full]] = True
        # a match that stops can't be part of a window that ends where it ends: go on from the word before
        end = np.where(twice, end, end - 1)
        at = np.where(twice, at - 1, end)
        lo, hi = np.where(twice, lo, 0), np.where(twice, hi, index.n)
        live = (at >= 0) & (end >= length - 1)
        who, end, at, lo, hi = who[live], end[live], at[live], lo[live], hi[live]


def fm_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, **kw) -> DataFrame:
    """See remove_repeats for rows, nulls and limits."""
    return remove_repeats(docs, matching_windows, length, anchor, **kw)
