"""An FM-index over sequences of small numbers: suffix order, wavelet-tree ranks, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order. 0 ends a sequence; the zeros count as different, earlier ones as smaller."""
    n = len(symbols)
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + int(ends.sum()))
    width, order = 1, np.argsort(rank, kind="stable")
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - width] = rank[width:]
        key = rank * (n + int(symbols.max(initial=0)) + 2) + after + 1
        order = np.argsort(key, kind="stable")
        sorted_keys = key[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        width *= 2
        if fresh[-1] == n - 1:
            return order


class WaveletRanks:
    """How often a symbol occurs before a position: one bit vector with running counts per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in reversed(range(bits)):
            ones = (symbols >> bit) & 1
            before = np.concatenate([[0], np.cumsum(ones)])
            self.levels.append((bit, before, len(symbols) - int(before[-1])))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        first = np.zeros(len(symbol), np.int64)
        last = position
        for bit, before, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            first = np.where(one, zeros + before[first], first - before[first])
            last = np.where(one, zeros + before[last], last - before[last])
        return last - first


class FMIndex:
    """Finds and locates patterns in ``symbols``, in which 0 ends each sequence (also the last)."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        order = suffix_order(symbols)
        self.n = len(symbols)
        self.last = symbols[order - 1]  # the symbol before each suffix
        self.ranks = WaveletRanks(self.last, max(1, int(n_symbols).bit_length()))
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols + 1))])
        starts_sequence = np.concatenate([[True], symbols[:-1] == 0])
        kept = starts_sequence[order] | (order % SAMPLE_EVERY == 0)
        self.sampled = np.where(kept, order, -1)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges ``[low, high)`` of the rows of ``patterns``, all of one length, read from their last symbol to the first."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for k in reversed(range(patterns.shape[1])):
            symbol = patterns[alive, k]
            low[alive] = self.smaller[symbol] + self.ranks.rank(symbol, low[alive])
            high[alive] = self.smaller[symbol] + self.ranks.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, position) of every occurrence: steps back from suffix to suffix until a sampled one."""
        counts = high - low
        pattern = np.repeat(np.arange(len(low)), counts)
        row = np.arange(len(pattern)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
        position = self.sampled[row]
        steps = np.zeros(len(row), np.int64)
        open_ = np.flatnonzero(position < 0)
        while len(open_):
            symbol = self.last[row[open_]]
            row[open_] = self.smaller[symbol] + self.ranks.rank(symbol, row[open_])
            steps[open_] += 1
            position[open_] = self.sampled[row[open_]]
            open_ = open_[position[open_] < 0]
        return pattern, position + steps
