"""An FM-index over integer sequences, with all patterns searched at once in numpy."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the text must end with a symbol smaller than all others and found once."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        bigger = np.empty(n, np.int64)
        bigger[0] = 0
        ordered = key[order]
        bigger[1:] = np.cumsum(ordered[1:] != ordered[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = bigger
        if bigger[-1] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletMatrix:
    """Rank of any symbol before any position, by one bit vector per bit of the alphabet."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (values >> b & 1).astype(bool)
            self.ones.append(np.append(0, np.cumsum(bit)).astype(np.int32))
            self.zeros.append(int((~bit).sum()))
            values = np.concatenate((values[~bit], values[bit]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            a, b = self.ones[k][low].astype(np.int64), self.ones[k][at].astype(np.int64)
            low = np.where(one, self.zeros[k] + a, low - a)
            at = np.where(one, self.zeros[k] + b, at - b)
        return at - low


class FMIndex:
    """Index of a text of positive integers; 0 separates its parts."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        # One final symbol below the separators ends the text.
        text = np.append(text.astype(np.int64) + 1, 0)
        order = suffix_order(text)
        self.last = text[order - 1]
        self.tree = WaveletMatrix(self.last)
        self.before = np.append(0, np.cumsum(np.bincount(text)))
        marked = order % sample == 0
        self.marked, self.mark_rank = marked, np.append(0, np.cumsum(marked))
        self.positions = order[marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of all patterns (rows of ``patterns``, left-aligned), by backward search."""
        n = len(self.last)
        lo, hi = np.zeros(len(lengths), np.int64), np.full(len(lengths), n, np.int64)
        top = len(self.before) - 1
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - back] + 1
            known = symbol < top
            hi[live[~known]] = lo[live[~known]]
            live, symbol = live[known], symbol[known]
            start = self.before[symbol]
            lo[live], hi[live] = start + self.tree.rank(symbol, lo[live]), start + self.tree.rank(symbol, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back until a sampled suffix is met."""
        out = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            found = self.marked[at]
            out[todo[found]] = self.positions[self.mark_rank[at[found]]] + steps
            todo, at = todo[~found], at[~found]
            symbol = self.last[at]
            at = self.before[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return out
