"""A compressed FM-index over word sequences: a wavelet matrix of the Burrows-Wheeler transform with packed bits."""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


class FMIndex:
    """Index of some word sequences, each with an owner; the smallest owner of a pattern's places is found by range minimum."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, owners: np.ndarray):
        """symbols: the words of all sequences, one after the other, as 64-bit values; lengths and owners: by sequence."""
        self.count = len(lengths)
        self.vocabulary, words = np.unique(symbols, return_inverse=True)
        # each sequence ends with a symbol of its own, smaller than all words
        n = len(symbols) + self.count
        self.ends = np.cumsum(lengths + 1) - 1
        text = np.empty(n, dtype=np.int64)
        inner = np.ones(n, dtype=bool)
        inner[self.ends] = False
        text[inner] = words.reshape(-1) + self.count
        text[self.ends] = np.arange(self.count)
        self.text, self.starts = text, self.ends - lengths
        self.sigma = self.count + len(self.vocabulary)
        order = suffix_array(text)
        self.first = np.searchsorted(text[order], np.arange(self.sigma + 1)).astype(np.int64)
        owner_ranks = np.repeat(owners, lengths + 1)[order]
        self.minima = [owner_ranks]
        step = 1
        while 2 * step <= n:
            last = self.minima[-1]
            self.minima.append(np.minimum(last[: n - 2 * step + 1], last[step : n - step + 1]))
            step *= 2
        self._wavelet(text[order - 1])

    def _wavelet(self, row: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.bits = max(1, int(self.sigma - 1).bit_length())
        where = np.zeros(self.sigma, dtype=np.int64)
        symbol = np.arange(self.sigma)
        for level in range(self.bits - 1, -1, -1):
            bit = (row >> level & 1).astype(bool)
            packed = np.packbits(np.r_[bit, np.zeros(-len(bit) % 64 + 64, dtype=bool)], bitorder="little").view(np.uint64)
            before = np.r_[0, np.cumsum(np.bitwise_count(packed))[:-1]].astype(np.int64)
            zeros = int((~bit).sum())
            self.levels.append((packed, before, zeros))
            ones = self._rank(packed, before, where)
            where = np.where(symbol >> level & 1, zeros + ones, where - ones)
            row = np.concatenate([row[~bit], row[bit]])
        self.block = where

    @staticmethod
    def _rank(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return before[word] + np.bitwise_count(packed[word] & ((ONE << (at & 63).astype(np.uint64)) - ONE))

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of symbol + pattern for patterns with places [low, high); elementwise."""
        n = len(symbol)
        at, twice = np.concatenate([low, high]), np.concatenate([symbol, symbol])
        for k, (packed, before, zeros) in enumerate(self.levels):
            ones = self._rank(packed, before, at)
            at = np.where(twice >> (self.bits - 1 - k) & 1, zeros + ones, at - ones)
        at += self.first[twice] - self.block[twice]
        return at[:n], at[n:]

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest owner in [low, high), which is not empty; elementwise."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=self.minima[0].dtype)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.minima[k][low[m]], self.minima[k][high[m] - (1 << k)])
        return out

    def matches(self, bound: np.ndarray, size: int) -> list[list[tuple[int, int]]]:
        """For each indexed sequence, the windows of size words that also lie in a sequence of an owner below its bound.

        Intervals [first, behind last) of window starts, from the right. All sequences are searched side by side, word by
        word from their ends: where a pattern can't grow, no window with the failing word reaches this far right, so the
        next search begins at the farthest end that is still open.
        """
        found: list[list[tuple[int, int]]] = [[] for _ in range(self.count)]
        length = self.ends - self.starts
        who = np.flatnonzero(length >= size)
        end, left = length[who].copy(), length[who].copy()
        low, high = np.zeros(len(who), np.int64), np.full(len(who), len(self.text), np.int64)
        while len(who):
            symbol = self.text[self.starts[who] + left - 1]
            new_low, new_high = self.back(symbol, low, high)
            good = new_high > new_low
            if good.any():
                good[good] = self.least_owner(new_low[good], new_high[good]) < bound[who[good]]
            left = left - good
            low, high = np.where(good, new_low, low), np.where(good, new_high, high)
            over = ~good | (left == 0)
            for k in np.flatnonzero(over & (end - left >= size)):
                found[who[k]].append((int(left[k]), int(end[k]) - size + 1))
            # begin anew further left; a search that reached the sequence's start is done
            again = np.flatnonzero(over)
            end[again] = np.where(left[again] == 0, 0, np.minimum(end[again] - 1, left[again] - 1 + size))
            left[again] = end[again]
            low[again], high[again] = 0, len(self.text)
            live = end >= size
            if not live.all():
                who, end, left, low, high = who[live], end[live], left[live], low[live], high[live]
        return found


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by doubling; each sequence's own end symbol bounds the rounds by the longest sequence."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].reshape(-1).astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        fresh = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or step >= n:
            return order
        step *= 2
