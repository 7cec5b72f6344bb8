"""An FM-index over whole symbols: backward search by ranks of a wavelet tree, and occurrences from sampled suffix positions.

A sequence holds symbols from 1 and breaks, 0. A break differs from every other one (they are ordered by place), so no occurrence
spans one and suffixes are told apart at the next break at the latest.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Start places of the suffixes of ``text`` (symbols below ``sigma``, a break at the end) in order.

    The first sort packs as many symbols as fit 62 bits; what ties is sorted again by the rank at twice the distance,
    or by place where a break has been met, until nothing ties."""
    n, bits = len(text), max(1, int(sigma - 1).bit_length())
    h = max(1, 62 // bits)
    key = text.astype(np.int64)
    for j in range(1, h):
        key[:-1] = np.where(text[:-1] > 0, (text[:-1].astype(np.int64) << (bits * j)) | key[1:], 0)
    sa = np.argsort(key)
    own = key[sa]
    fresh = np.concatenate([[True], own[1:] != own[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    tied = np.flatnonzero(~(fresh & np.concatenate([fresh[1:], [True]])))
    stops = np.flatnonzero(text == 0)
    stop = stops[np.searchsorted(stops, np.arange(n))] if len(tied) else stops
    while len(tied):
        at = sa[tied]
        met = stop[at] - at < h
        key = rank[at] * n + np.where(met, at, rank[np.where(met, at, at + h)])
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[tied] = at
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        tied = tied[~(fresh & np.concatenate([fresh[1:], [True]]))]
        h *= 2
    return sa


class WaveletTree:
    """Ranks of symbols below ``sigma``: one level of bits each, all nodes of a level in one array (zeros before ones)."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(int(len(symbols) - ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.begin = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            up = ones[at]
            at = np.where((symbols >> (self.bits - 1 - k)) & 1, zeros + up, at - up)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbols, at) - self.begin[symbols]

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the places, and their ranks there."""
        symbols = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            up = ones[at]
            bit = ones[at + 1] - up
            at = np.where(bit, zeros + up, at - up)
            symbols = symbols * 2 + bit
        return symbols, at - self.begin[symbols]


class FMIndex:
    """Search and location of phrases in a sequence; every ``every``-th place of it and those after breaks keep their positions."""

    def __init__(self, text: np.ndarray, sigma: int, every: int = 8):
        sa = suffix_array(text, sigma)
        last = text[sa - 1]  # of the first place the final break
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        self.tree = WaveletTree(last, sigma)
        kept = (sa % every == 0) | (last == 0)
        self.kept, self.position = np.concatenate([[0], np.cumsum(kept)]), sa[kept]

    def search(self, phrases: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase: rows of ``phrases``, whose first ``size`` symbols count. Symbols
        are below sigma and not 0."""
        rows = np.arange(len(phrases))
        symbol = phrases[rows, size - 1]
        low, high = self.less[symbol], self.less[symbol + 1]
        for k in range(2, phrases.shape[1] + 1):
            rows = rows[(low[rows] < high[rows]) & (size[rows] >= k)]
            if not len(rows):
                break
            symbol = phrases[rows, size[rows] - k]
            low[rows] = self.less[symbol] + self.tree.rank(symbol, low[rows])
            high[rows] = self.less[symbol] + self.tree.rank(symbol, high[rows])
        return low, np.maximum(low, high)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Places in the sequence of the suffixes at ``at``: steps back to a kept one."""
        at, out, steps, rows = at.copy(), np.empty(len(at), np.int64), 0, np.arange(len(at))
        while len(rows):
            there = at[rows]
            known = self.kept[there + 1] > self.kept[there]
            out[rows[known]] = self.position[self.kept[there[known]]] + steps
            rows, there, steps = rows[~known], there[~known], steps + 1
            symbol, rank = self.tree.read(there)
            at[rows] = self.less[symbol] + rank
        return out
