"""A bounded memory of variable-length integer rows by key, read by vectorised gathers."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence

import numpy as np


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of every row, one row after the other."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)


class RaggedCache(dict):
    """key -> row number; rows are integer arrays that ``compute`` makes for the keys that were missing.

    ``compute`` gets a list of distinct keys and returns the integers of all of them, one after the other, and the
    number of integers of each. At ``limit`` keys, or ``most`` integers, the cache starts afresh before the next batch;
    that bounds memory and never changes a result.
    """

    def __init__(self, compute: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int, most: int = 4_000_000) -> None:
        super().__init__()
        self._compute, self._limit, self._most = compute, limit, most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self._pending: list[Hashable] = []
        self._flat = np.empty(1 << 16, dtype=np.int32)
        self._used = 0
        self._start = np.empty(1 << 14, dtype=np.int64)
        self._size = np.empty(1 << 14, dtype=np.int64)
        self._rows = 0

    def __missing__(self, key: Hashable) -> int:
        row = self[key] = self._rows + len(self._pending)
        self._pending.append(key)
        return row

    def begin(self) -> None:
        """To be called before a batch: rows handed out earlier lose their meaning when the cache starts afresh."""
        if len(self) >= self._limit or self._used >= self._most:
            self.reset()

    def rows(self, keys: Sequence[Hashable]) -> np.ndarray:
        """The row of each key; the missing ones are computed."""
        rows = np.fromiter(map(self.__getitem__, keys), dtype=np.int64, count=len(keys))
        if self._pending:
            flat, sizes = self._compute(self._pending)
            n, total = len(sizes), len(flat)
            while self._rows + n > len(self._start):
                self._start, self._size = (np.concatenate([x, np.empty_like(x)]) for x in (self._start, self._size))
            while self._used + total > len(self._flat):
                self._flat = np.concatenate([self._flat, np.empty_like(self._flat)])
            self._size[self._rows : self._rows + n] = sizes
            self._start[self._rows : self._rows + n] = self._used + np.cumsum(sizes) - sizes
            self._flat[self._used : self._used + total] = flat
            self._used, self._rows, self._pending = self._used + total, self._rows + n, []
        return rows

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        return self._size[rows]

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The integers of these rows, one row after the other."""
        return self._flat[spread(self._start[rows], self._size[rows])]
