"""A double-array trie over sequences of dense symbols, built level by level, and what its nodes add up to."""

from __future__ import annotations

import numpy as np

#: Free places tried for a node with several children before it goes behind all others.
TRIES = 16


def dense(items: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers from 0 for equal items, by first appearance in ``order``: children of a node are then near each other."""
    _, first, number = np.unique(items[order], return_index=True, return_inverse=True)
    renamed = np.empty(len(first), np.int64)
    renamed[np.argsort(first)] = np.arange(len(first))
    out = np.empty(len(items), np.int64)
    out[order] = renamed[number]
    return out


class DoubleArray:
    """BASE and CHECK of a trie: the child of state s by symbol c is state BASE[s] + c, and it exists where CHECK there is s. State 0
    is the root. ``symbols[offsets[i]:offsets[i + 1]]`` is the i-th sequence; sequences that share a prefix are next to each other."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray):
        size = int(len(symbols) + (symbols.max(initial=0)) + 2)
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.check[0], self.top = -2, 1
        state, lengths = np.zeros(len(offsets) - 1, np.int64), np.diff(offsets)
        for j in range(int(lengths.max(initial=0))):
            rows = np.flatnonzero(lengths > j)
            parent, symbol = state[rows], symbols[offsets[rows] + j]
            new = np.ones(len(rows), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (symbol[1:] != symbol[:-1])
            self._place(parent[new], symbol[new])
            state[rows] = self.base[parent] + symbol
        self.base, self.check = self.base[: self.top], self.check[: self.top]

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.append(self.base, np.zeros(more, np.int64)), np.append(self.check, np.full(more, -1, np.int64))

    def _place(self, parent: np.ndarray, symbol: np.ndarray) -> None:
        starts = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        counts = np.diff(np.append(starts, len(parent)))
        free = np.flatnonzero(self.check[: self.top] == -1)
        for at, k in zip(starts[counts > 1], counts[counts > 1]):
            own, s = symbol[at : at + k], parent[at]
            least = own.min()
            for f in (*free[:TRIES], self.top):
                there = own + (f - least)
                self._grow(int(there.max()) + 1)
                if (self.check[there] == -1).all():
                    break
            self.base[s], self.check[there] = f - least, s
            self.top = max(self.top, int(there.max()) + 1)
        alone = starts[counts == 1]
        free = np.flatnonzero(self.check[: self.top] == -1)[: len(alone)]
        there = np.concatenate([free, np.arange(self.top, self.top + len(alone) - len(free))])
        self._grow(self.top + len(alone))
        self.base[parent[alone]], self.check[there] = there - symbol[alone], parent[alone]
        self.top = max(self.top, int(there.max(initial=0)) + 1)

    def walk(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The state after each symbol of each sequence, -1 where the trie has none."""
        out, lengths = np.full(len(symbols), -1, np.int64), np.diff(offsets)
        state, rows, j = np.zeros(len(lengths), np.int64), np.flatnonzero(lengths > 0), 0
        while len(rows):
            to = self.base[state[rows]] + symbols[offsets[rows] + j]
            known = (to >= 0) & (to < len(self.check))
            known[known] = self.check[to[known]] == state[rows[known]]
            rows, to = rows[known], to[known]
            state[rows] = out[offsets[rows] + j] = to
            j += 1
            rows = rows[lengths[rows] > j]
        return out
