"""Byte-pair merges of many words at once: every step merges the best pair of every word that still has one."""

from __future__ import annotations

import numpy as np

_NONE = np.int64(1 << 40)


class PairTable:
    """Which pairs of symbols merge, in what order of preference, and into which symbol."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, symbols: int) -> None:
        key = left.astype(np.int64) * symbols + right
        order = np.lexsort((rank, key))
        key, rank, merged = key[order], np.asarray(rank, np.int64)[order], np.asarray(merged, np.int64)[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        self._key, self._rank, self._merged, self._symbols = key[first], rank[first], merged[first], symbols

    def _at(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self._symbols + right
        at = np.minimum(np.searchsorted(self._key, key), len(self._key) - 1)
        return at, (self._key[at] == key) & (left >= 0) & (right >= 0)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at, found = self._at(left, right)
        return np.where(found, self._rank[at], _NONE)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self._merged[self._at(left, right)[0]]


def merge_all(table: PairTable, flat: np.ndarray, sizes: np.ndarray, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols of words given as their symbols one after the other and the number of symbols of each (1 or
    more). In each word the pair of the lowest rank merges first, of several the leftmost, until none is left."""
    start = np.cumsum(sizes) - sizes
    out_size = np.empty(len(sizes), dtype=np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    order = np.argsort(sizes, kind="stable")
    for lo in range(0, len(order), block):
        words = order[lo : lo + block]
        width = int(sizes[words[-1]])
        column = np.arange(width)
        inside = column < sizes[words][:, None]
        m = np.where(inside, flat[np.minimum(start[words][:, None] + column, len(flat) - 1)], -1).astype(np.int64)
        _merge_block(table, m)
        out_size[words] = (m >= 0).sum(axis=1)
        parts.append((words, m))
    out_start = np.cumsum(out_size) - out_size
    out = np.empty(int(out_size.sum()), dtype=np.int64)
    for words, m in parts:
        row, column = np.nonzero(m >= 0)
        out[out_start[words][row] + column] = m[row, column]
    return out, out_size


def _merge_block(table: PairTable, m: np.ndarray) -> None:
    """Merges in place; symbols stay to the left, -1 fills the rest."""
    if m.shape[1] < 2:
        return
    rows = np.arange(len(m))
    work = m
    rank = table.rank(work[:, :-1], work[:, 1:])
    while True:
        at = rank.argmin(axis=1)
        active = rank[np.arange(len(rank)), at] < _NONE
        if not active.all():
            m[rows[~active], : work.shape[1]] = work[~active]
            m[rows[~active], work.shape[1] :] = -1
            rows, work, rank, at = rows[active], work[active], rank[active], at[active]
        if not len(rows):
            return
        i, column = np.arange(len(rows)), np.arange(work.shape[1])
        new = table.merged(work[i, at], work[i, at + 1])
        shift = column[None, :-1] > at[:, None]
        left = np.where(shift, work[:, 1:], work[:, :-1])
        left[i, at] = new
        work = np.concatenate([left, np.full((len(rows), 1), -1)], axis=1)
        rank = np.concatenate([np.where(shift[:, :-1], rank[:, 1:], rank[:, :-1]), np.full((len(rows), 1), _NONE)], axis=1)
        rank[i, at] = table.rank(new, work[i, at + 1])
        before = np.flatnonzero(at > 0)
        rank[before, at[before] - 1] = table.rank(work[before, at[before] - 1], new[before])
