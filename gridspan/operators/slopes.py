"""Exact order statistics of the slopes of all pairs of points, without the pairs.

The slope of two points is at most m where, after m * x is taken off, the later
point does not stand above the earlier one. So the number of slopes up to m is
a number of inversions, which merging counts in n log n steps. Bounds are drawn
together around a rank, by the slopes of some pairs and then by halving, until
few pairs lie between them; only those are made, and the slope with the rank is
among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Points up to which all pairs are made at once.
FEW = 64
#: Pairs between the bounds, for each point, that are made.
BETWEEN = 8


def _levels(rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each width 1, 2, 4, ..: (block of each left element, left ranks in order by block, where each right element stands among its block's left, order of the right)."""
    n, width = len(rank), 1
    place = np.arange(n)
    while width < n:
        block, right = place // (2 * width), (place // width) % 2 == 1
        order = np.lexsort((rank, block))  # by block, then rank
        left = order[~right[order]]
        other = order[right[order]]
        key = block[left] * (n + 1) + rank[left]
        stands = np.searchsorted(key, block[other] * (n + 1) + rank[other], side="left")
        end = np.searchsorted(block[left], block[other], side="right")
        yield left, other, stands, end
        width *= 2


def inversions(z: np.ndarray) -> int:
    """Pairs i < j with z[i] >= z[j]."""
    rank = _ranks(z)
    return sum(int((end - stands).sum()) for _, _, stands, end in _levels(rank))


def _ranks(z: np.ndarray) -> np.ndarray:
    """Dense ranks."""
    return np.unique(z, return_inverse=True)[1]


def _inverted(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that ``inversions`` counts."""
    first, second = [], []
    for left, other, stands, end in _levels(_ranks(z)):
        n = end - stands
        at = np.repeat(stands - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        first.append(left[at])
        second.append(np.repeat(other, n))
    return np.concatenate(first or [np.zeros(0, np.int64)]), np.concatenate(second or [np.zeros(0, np.int64)])


class Slopes:
    """The slopes of the pairs of points with different x, in order of size, by rank."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        order = np.lexsort((y, x))
        self.x, self.y = np.asarray(x, float)[order], np.asarray(y, float)[order]
        n = len(order)
        self.at = self.x - self.x[n // 2] if n else self.x  # small numbers lose less
        same_x = np.unique(self.x, return_counts=True)[1].astype(object)
        points = np.unique(np.stack([self.x, self.y]), axis=1, return_counts=True)[1].astype(object) if n else same_x
        self.twice = int((points * (points - 1) // 2).sum())  # equal points are counted as inverted
        self.pairs = n * (n - 1) // 2 - int((same_x * (same_x - 1) // 2).sum())
        self.all = None
        if n <= FEW:
            i, j = np.triu_indices(n, 1)
            self.all = np.sort(self._slope(*(k[self.x[i] < self.x[j]] for k in (i, j))))
        else:
            gap = np.diff(np.unique(self.x))
            self.error = 16 * np.finfo(float).eps / (gap.min() if len(gap) else 1.0)

    def _slope(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.y[j] - self.y[i]) / (self.x[j] - self.x[i])

    def upto(self, m: float) -> int:
        """Slopes of at most ``m``, but for rounding."""
        return inversions(self.y - m * self.at) - self.twice

    def _blur(self, m: float) -> float:
        """How far from ``m`` a slope can be that is counted on the wrong side."""
        return self.error * (np.abs(self.y).max() + abs(m) * np.abs(self.at).max()) + 4 * np.finfo(float).eps * abs(m)

    def _between(self, low: float, high: float) -> np.ndarray:
        """The slopes that are counted up to ``high`` and not up to ``low``."""
        z = self.y - low * self.at
        order = np.lexsort((-np.arange(len(z)), z))  # of equal ones the later first: counted up to low
        i, j = _inverted((self.y - high * self.at)[order])
        i, j = order[i], order[j]
        keep = self.x[i] < self.x[j]
        return np.sort(self._slope(i[keep], j[keep]))

    def at_rank(self, k: int) -> float:
        """The k-th smallest slope, from 0."""
        if self.all is not None:
            return float(self.all[k])
        rng, n = np.random.default_rng(0), len(self.x)
        i, j = np.sort(rng.integers(0, n, (2, 8 * n + 4096)), axis=0)
        some = np.sort(self._slope(*(q[self.x[i] < self.x[j]] for q in (i, j))))
        guess, slack = k / self.pairs * (len(some) - 1), 4 * np.sqrt(len(some))
        low, high = float(some[int(max(guess - slack, 0))]), float(some[int(min(guess + slack, len(some) - 1))])
        wide = max(high - low, abs(low), abs(high), 1e-300)
        low, high = low - 4 * self._blur(low), high + 4 * self._blur(high)
        while (below := self.upto(low)) > k:
            low, wide = low - wide, 2 * wide
        while (above := self.upto(high)) <= k:
            high, wide = high + wide, 2 * wide
        while above - below > BETWEEN * n and high - low > 16 * max(self._blur(low), self._blur(high)):
            middle = low + (high - low) / 2
            count = self.upto(middle)
            low, below, high, above = (middle, count, high, above) if count <= k else (low, below, middle, count)
        while True:
            if above - below > 64 * BETWEEN * n:  # slopes that differ by rounding only
                return self._one_of_many(low, high)
            found = self._between(low, high)
            value = float(found[min(k - below, len(found) - 1)])
            blur_low, blur_high = self._blur(low), self._blur(high)
            if low + blur_low < value < high - blur_high:
                return value
            low, high = (low - 4 * blur_low, high) if value <= low + blur_low else (low, high + 4 * blur_high)
            below, above = self.upto(low), self.upto(high)

    def _one_of_many(self, low: float, high: float) -> float:
        """A slope between bounds that no rounding can tell apart: the first that is found, point by point."""
        for i in range(len(self.x) - 1):
            j = np.flatnonzero(self.x[i + 1 :] > self.x[i]) + i + 1
            s = self._slope(np.full(len(j), i), j)
            s = s[(s >= low) & (s <= high)]
            if len(s):
                return float(np.median(s) if s.min() < s.max() else s[0])
        return (low + high) / 2

    def median(self) -> float:
        if not self.pairs:
            return float("nan")
        a = self.at_rank((self.pairs - 1) // 2)
        return a if self.pairs % 2 else (a + self.at_rank(self.pairs // 2)) / 2
