"""Suffix arrays over integer ids by prefix doubling in numpy, with common extensions from the ranks of each doubling."""

from __future__ import annotations

import numpy as np


class Suffixes:
    """The suffix array of ``ids`` (integers of 0 or more; every separator, the first and the last id included, is unique).

    ``levels[l]`` has a rank for each place: the first place in the array, among suffixes ordered by their first 2**l ids, of
    those that share all these ids with it. As separators are unique, two places have equal ranks only if 2**l ids without a
    separator are equal. With ``longest`` the array is ordered by that many ids at least, else completely.
    """

    def __init__(self, ids: np.ndarray, longest: int | None = None):
        n = len(ids)
        self.levels: list[np.ndarray] = []
        key, step = ids.astype(np.int64), 0
        while True:
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            fresh = np.append(True, sorted_[1:] != sorted_[:-1])
            rank = np.empty(n, np.int32)
            rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            self.levels.append(rank)
            self.array = order
            step = step * 2 or 1
            if fresh.all() or (longest is not None and step >= longest):
                break
            key = rank * np.int64(n + 1)
            key[: n - step] += rank[step:] + 1

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many ids from ``a`` on equal those from ``b`` on (different places), by pairs; an incomplete array tells no
        more than twice its order less one."""
        a, b = a.copy(), b.copy()
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            equal = np.where(self.levels[level][a] == self.levels[level][b], 1 << level, 0)
            out += equal
            a += equal
            b += equal
        return out

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many ids that end before ``a`` equal those that end before ``b``, by pairs of different places."""
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            x, y = a - out - (1 << level), b - out - (1 << level)
            equal = (x >= 0) & (y >= 0)
            equal &= self.levels[level][np.maximum(x, 0)] == self.levels[level][np.maximum(y, 0)]
            out += np.where(equal, 1 << level, 0)
        return out

    def interval(self, at: np.ndarray, length: int | np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The part of the array whose suffixes share their first ``length`` ids with ``at``; 2**level is the largest power
        of two that isn't above ``length``. Within the interval of the first 2**level ids the suffixes are ordered by the last
        2**level, so its bounds are found by bisection."""
        rank, shift = self.levels[level], length - (1 << level)
        low = rank[at].astype(np.int64)
        high = low + np.bincount(rank, minlength=len(rank))[low]
        wanted = rank[at + shift]
        bounds = []
        for above in (False, True):
            a, b = low.copy(), high.copy()
            while (open_ := a < b).any():
                middle = (a + b) >> 1
                value = rank[np.minimum(self.array[np.minimum(middle, len(rank) - 1)] + shift, len(rank) - 1)]
                right = open_ & ((value <= wanted) if above else (value < wanted))
                a = np.where(right, middle + 1, a)
                b = np.where(open_ & ~right, middle, b)
            bounds.append(a)
        return bounds[0], bounds[1]
