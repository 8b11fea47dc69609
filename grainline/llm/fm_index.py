"""An FM-index over integer symbols in numpy: suffix order, wavelet ranks, sampled positions.

All searches are done for many patterns at once, so no step loops over symbols.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, top: int) -> np.ndarray:
    """Start positions of all suffixes of ``text`` (symbols 0..top) in order.

    First by as many symbols as fit in one word, then by prefix doubling on the
    suffixes that are still tied.
    """
    n = len(text)
    bits = max(1, int(top + 1).bit_length())
    span = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(span):
        key <<= bits
        if k < n:
            key[: n - k] |= text[k:].astype(np.int64) + 1
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    reach = span
    while True:
        tied = np.flatnonzero(~(fresh & np.concatenate((fresh[1:], [True]))))
        if not len(tied):
            return order
        places = order[tied]
        group = rank[places]
        after = places + reach
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((second, group))
        order[tied] = places[by]
        group, second = group[by], second[by]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
        fresh[tied] = new
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        reach *= 2


class WaveletMatrix:
    """Rank and access over symbols, one bit plane after another."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        now = symbols
        for level in range(bits - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(now) - int(self.ones[-1][-1]))
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low = np.zeros_like(at)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            low = np.where(bit == 1, zeros + ones[low], low - ones[low])
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            symbol = (symbol << 1) | bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return symbol


class FMIndex:
    """Counts and locates patterns in ``text``; symbol 0 only parts its runs."""

    def __init__(self, text: np.ndarray, top: int, every: int = 8):
        text, top = np.concatenate((text + 1, [0])), top + 1  # a last symbol of its own, below all
        order = suffix_order(text, top)
        last = text[order - 1]
        self.n = len(text)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 2))))
        self.tree = WaveletMatrix(last.astype(np.int64), max(1, int(top).bit_length()))
        kept = order % every == 0
        self.sampled = kept
        self.sample_at = np.concatenate(([0], np.cumsum(kept, dtype=np.int64)))
        self.samples = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of patterns, one a row, by backward search."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[:, k] + 1
            low = self.smaller[symbol] + self.tree.rank(symbol, low)
            high = self.smaller[symbol] + self.tree.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step back until a sampled one is met."""
        found = np.empty(len(rows), np.int64)
        active, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(active):
            done = self.sampled[rows]
            found[active[done]] = self.samples[self.sample_at[rows[done]]] + steps
            active, rows = active[~done], rows[~done]
            symbol = self.tree.access(rows)
            rows = self.smaller[symbol] + self.tree.rank(symbol, rows)
            steps += 1
        return found
