"""Open-addressing tables of 64-bit keys in numpy, for lookups of whole columns."""

from __future__ import annotations

import numpy as np

from sonarframe.llm import textnum as N


class KeyTable:
    """Index of each key of ``keys`` (uint64, distinct), -1 for others.  Load is at most a half."""

    def __init__(self, keys: np.ndarray):
        self._allocate(len(keys))
        self._insert(keys)

    def _allocate(self, n: int) -> None:
        size = max(1024, 2 << int(max(1, n) - 1).bit_length())
        self.n, self.mask = 0, np.uint64(size - 1)
        self.keys = np.zeros(size, dtype=np.uint64)
        self.index = np.full(size, -1, dtype=np.int32)

    def _insert(self, keys: np.ndarray) -> None:
        at = (N.mix(keys) & self.mask).astype(np.int64)
        number, todo = np.arange(self.n, self.n + len(keys), dtype=np.int32), np.arange(len(keys))
        while len(todo):
            free = self.index[at] < 0
            self.index[at[free]] = number[todo[free]]  # of several on one place, the last stays
            won = self.index[at] == number[todo]
            self.keys[at[won]] = keys[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & int(self.mask)
        self.n += len(keys)

    def add(self, keys: np.ndarray) -> None:
        """More distinct keys, numbered on; the table doubles when it's half full."""
        if 2 * (self.n + len(keys)) > len(self.index):
            used = self.index >= 0
            old = np.empty(self.n, dtype=np.uint64)
            old[self.index[used]] = self.keys[used]
            self._allocate(2 * (self.n + len(keys)))
            self._insert(old)
        self._insert(keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = (N.mix(keys) & self.mask).view(np.int64)
        out = self.index.take(at, mode="clip")  # all are within: the mode that checks least
        again = np.flatnonzero((out >= 0) & (self.keys.take(at, mode="clip") != keys))
        out[again] = -1
        at = at[again]
        while len(again):
            at = (at + 1) & int(self.mask)
            got = self.index[at]
            hit = (got >= 0) & (self.keys[at] == keys[again])
            out[again[hit]] = got[hit]
            go_on = (got >= 0) & ~hit
            again, at = again[go_on], at[go_on]
        return out
