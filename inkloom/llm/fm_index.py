"""FM-index over a sequence of small integers: backward search by wavelet-tree ranks, sampled suffixes."""

from __future__ import annotations

import numpy as np

SAMPLED = 16


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; seq must end in its only least symbol."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class Wavelet:
    """Ranks of symbols in a sequence: one bit of every symbol a level, zeros before ones."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits = bits
        self.ones, self.zeros = [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(seq) - self.ones[-1][-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.start = self._descend(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[k][i]
            i = np.where((symbol >> level) & 1 == 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the first i places."""
        return self._descend(symbol, i) - self.start[symbol]


class FMIndex:
    """Index of seq, whose symbols are at least 1; 0 is added at the end."""

    def __init__(self, seq: np.ndarray):
        seq = np.append(seq, 0).astype(np.int64)
        order = suffix_order(seq)
        self.bwt = seq[order - 1]
        bits = max(1, int(seq.max()).bit_length())
        self.tree = Wavelet(self.bwt, bits)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=1 << bits))])
        self.symbols = 1 << bits
        self.marked = order % SAMPLED == 0
        self.sample = order[self.marked]
        self.before = np.cumsum(self.marked) - 1

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [low, high) of suffixes that begin with each pattern; patterns are rows, filled with 0."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        high[(patterns >= self.symbols).any(1)] = 0
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - 1 - step]
            low[live] = self.below[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.below[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in seq of suffixes, by walking to a sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.marked[rows[live]]
            hit = live[done]
            out[hit] = self.sample[self.before[rows[hit]]] + steps[hit]
            live = live[~done]
            symbol = self.bwt[rows[live]]
            rows[live] = self.below[symbol] + self.tree.rank(symbol, rows[live])
            steps[live] += 1
        return out
