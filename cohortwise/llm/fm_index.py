"""An FM-index over integer symbols: wavelet ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np

from .shared import ranges

SAMPLE = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order. Symbol 0 separates runs: each separator is a
    symbol of its own, ordered by position, so no comparison goes past one.

    Prefix doubling; a round sorts only the suffixes that still share their rank with another.
    """
    n = len(symbols)
    separators = symbols == 0
    key = symbols.astype(np.int64) + int(separators.sum())
    key[separators] = np.arange(int(separators.sum()))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    rank = np.empty(n, np.int64)
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    # The rank of a group is the place of its first suffix, so ranks stay right when a group splits.
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = first
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    reach = 1
    while len(slots):
        open_ = order[slots]
        after = np.where(open_ + reach < n, rank[np.minimum(open_ + reach, n - 1)] + 1, 0)
        group = rank[open_]
        by = np.argsort(group * (n + 1) + after, kind="stable")
        open_, group, after = open_[by], group[by], after[by]
        order[slots] = open_
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        rank[open_] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.append(new[1:], True))]
        reach *= 2
    return order


class FMIndex:
    """Finds patterns of non-zero symbols in a text of symbols below `sigma` that ends with 0."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.bits = len(symbols), max(1, int(sigma - 1).bit_length())
        suffixes = suffix_array(symbols)
        last = symbols[suffixes - 1].astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        # Wavelet matrix: per level, zeros before each place; the next level has the zeros first.
        self.zeros: list[np.ndarray] = []
        level = last
        for bit in range(self.bits - 1, -1, -1):
            one = (level >> bit & 1).astype(bool)
            before = np.zeros(self.n + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)
            level = np.concatenate([level[~one], level[one]])
        self.last = last
        # Sampled: every SAMPLE-th position, and those after a separator, which no walk can pass.
        kept = (suffixes % SAMPLE == 0) | (last == 0)
        self.sampled = np.zeros(self.n + 1, np.int32)
        np.cumsum(kept, out=self.sampled[1:])
        self.kept, self.positions = kept, suffixes[kept]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first `at` last symbols."""
        low = np.zeros_like(at)
        for bit, before in zip(range(self.bits - 1, -1, -1), self.zeros):
            one = (symbol >> bit & 1).astype(bool)
            zeros = before[-1]
            low = np.where(one, zeros + low - before[low], before[low])
            at = np.where(one, zeros + at - before[at], before[at])
        return at - low

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern.

        `patterns` is a matrix whose rows end with their pattern's last symbol.
        """
        low = np.zeros(len(patterns), np.int64)
        high = np.where(lengths > 0, self.n, 0)
        width = patterns.shape[1]
        for step in range(width):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, width - 1 - step].astype(np.int64)
            low[live] = self.first[symbol] + self.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text positions of all suffixes in the given rows, and the pattern each belongs to."""
        rows = ranges(low, high - low)
        pattern = np.repeat(np.arange(len(low)), high - low)
        found, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = rows[open_]
            done = self.kept[here]
            found[open_[done]] = self.positions[self.sampled[here[done]]] + steps[open_[done]]
            open_, here = open_[~done], here[~done]
            symbol = self.last[here]
            rows[open_] = self.first[symbol] + self.rank(symbol, here)
            steps[open_] += 1
        return found, pattern
