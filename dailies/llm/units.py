"""Token ids of texts through a table of the distinct units met so far in one Python worker."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np


class UnitTable:
    """Ids of units (words with what precedes them), each encoded when first met.

    At ``limit`` units those met least are dropped, so memory stays bounded; ids never depend on what is held.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self._empty()

    def _empty(self) -> None:
        self.rows: dict[str, int] = {}
        self.starts, self.lengths, self.met = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.int32)
        self.used = 0

    def _shrink(self) -> None:
        """Keep units met more often than others, at most half the limit."""
        n = len(self.rows)
        least = max(2, int(np.partition(self.met[:n], n - self.limit // 2)[n - self.limit // 2]) + 1)
        kept = np.flatnonzero(self.met[:n] >= least)
        units, lengths, met = list(self.rows), self.lengths[kept], self.met[kept]
        ids = self.flat[np.concatenate([np.arange(a, a + k) for a, k in zip(self.starts[kept], lengths)] or [np.zeros(0, np.int64)])]
        self._empty()
        self._put([units[i] for i in kept], ids, lengths)
        self.met[: len(kept)] = met // 2

    def _put(self, units: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first, n = len(self.rows), len(units)
        while first + n > len(self.starts):
            self.starts, self.lengths, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.met))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.lengths[first : first + n] = lengths
        self.starts[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.rows.update(zip(units, range(first, first + n)))

    def _forget(self, n: int, used: int) -> None:
        """Drop what was put in after the first ``n`` units; an array that one long unit made large is cut back."""
        self.met[n : len(self.rows)] = 0
        while len(self.rows) > n:
            self.rows.popitem()
        self.used = used
        if len(self.flat) > 4 * max(used, 1 << 18):
            self.flat = self.flat[: max(used, 1 << 18)].copy()

    #: Longer units are encoded each time and not kept, so that the table is bounded in characters too.
    LONGEST = 64

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (given as their units) one after the other, and how many each has."""
        units = [u for t in texts for u in t]
        at = np.fromiter(map(self.rows.get, units, repeat(-1)), np.int64, len(units))
        fresh, long = np.flatnonzero(at < 0), []
        if len(fresh):
            new = list(dict.fromkeys([units[i] for i in fresh]))
            if len(self.rows) + len(new) > self.limit:
                self._shrink()
                new = list(set(units).difference(self.rows))
                fresh = np.arange(len(units))
            long = [u for u in new if len(u) > self.LONGEST]
            if len(long) < len(new):
                new = [u for u in new if len(u) <= self.LONGEST] if long else new
                self._put(new, *self.encode(new))
            before = len(self.rows), self.used
            if long:  # behind the others, for this call only
                self._put(long, *self.encode(long))
            at[fresh] = np.fromiter(map(self.rows.__getitem__, [units[i] for i in fresh]), np.int64, len(fresh))
        self.met[: len(self.rows)] += np.bincount(at, minlength=len(self.rows))
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) - np.repeat(ends - lengths - self.starts[at], lengths)]
        if long:
            self._forget(*before)
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate([[0], ends])[np.cumsum(counts)]
        return ids, np.diff(np.concatenate([[0], bounds]))

    def ids_of(self, distinct: list[str], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units given as places in a list of distinct ones, one after the other, and how many each unit has."""
        rows = np.fromiter(map(self.rows.get, distinct, repeat(-1)), np.int64, len(distinct))
        long = [i for i in np.flatnonzero(rows < 0).tolist() if len(distinct[i]) > self.LONGEST]
        kept = np.ones(len(distinct), bool)
        kept[long] = False
        fresh = np.flatnonzero((rows < 0) & kept)
        if len(fresh):
            if len(self.rows) + len(fresh) > self.limit and 2 * len(self.rows) > self.limit:
                self._shrink()
                rows = np.fromiter(map(self.rows.get, distinct, repeat(-1)), np.int64, len(distinct))
                fresh = np.flatnonzero((rows < 0) & kept)
            new = [distinct[i] for i in fresh.tolist()]
            first = len(self.rows)
            self._put(new, *self.encode(new))
            rows[fresh] = np.arange(first, first + len(new))
        met = np.bincount(at, minlength=len(distinct))
        self.met[rows[kept]] += met[kept]
        starts, lengths = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        starts[kept], lengths[kept] = self.starts[rows[kept]], self.lengths[rows[kept]]
        flat = self.flat
        if long:  # few, behind what is kept
            more, lengths[long] = self.encode([distinct[i] for i in long])
            starts[long] = self.used + np.cumsum(lengths[long]) - lengths[long]
            flat = np.concatenate([self.flat[: self.used], more])
        each = lengths[at]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        return flat[np.arange(total) - np.repeat(ends - each - starts[at], each)], each


def groups(texts: list[str], size: int) -> list[tuple[int, int]]:
    """Ranges of texts with about ``size`` characters together."""
    out, first, total = [], 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            out.append((first, i + 1))
            first, total = i + 1, 0
    return out + ([(first, len(texts))] if first < len(texts) else [])
