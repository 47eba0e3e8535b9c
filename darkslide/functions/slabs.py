"""Trapezoidal decomposition of overlapping regions: a point is found by two binary searches."""

from __future__ import annotations

import numpy as np


class Slabs:
    """Vertical slabs between neighbouring vertices and crossings; in each, the edges across it from low to high and, between them, the regions there.

    Edges are rows (x0, y0, x1, y1, region); a region is where the number of its edges below is odd, so holes,
    several pieces and self-overlaps follow the even-odd rule. Vertical edges bound no slab and are left out.
    """

    def __init__(self, edges: np.ndarray, regions: np.ndarray, low: float = -np.inf, high: float = np.inf) -> None:
        swap = edges[:, 0] > edges[:, 2]
        edges = np.where(swap[:, None], edges[:, [2, 3, 0, 1]], edges)
        kept = (edges[:, 0] < edges[:, 2]) & (edges[:, 2] > low) & (edges[:, 0] < high)
        self.edges, self._regions = edges[kept], regions[kept]
        x = self.edges[:, [0, 2]].ravel()
        bounds = np.unique(np.concatenate([x[(x > low) & (x < high)], [v for v in (low, high) if np.isfinite(v)]]))
        self.bounds = np.unique(np.concatenate([bounds, self._crossings(bounds)]))
        order, starts, inside, gap_starts = [], [0], [], [0]
        for a, b in zip(self.bounds[:-1], self.bounds[1:]):
            across = np.flatnonzero((self.edges[:, 0] <= a) & (self.edges[:, 2] >= b))
            across = across[np.argsort(self._y(across, (a + b) / 2), kind="stable")]
            order.append(across)
            starts.append(starts[-1] + len(across))
            odd: set[int] = set()
            for e in [None, *across]:
                if e is not None:
                    odd ^= {int(self._regions[e])}
                inside.extend(sorted(odd))
                gap_starts.append(len(inside))
        self._order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self._starts, self._inside, self._gaps = np.array(starts), np.array(inside, np.int64), np.array(gap_starts)

    def _y(self, e: np.ndarray, x) -> np.ndarray:
        x0, y0, x1, y1 = self.edges[e].T
        return y0 + (x - x0) * ((y1 - y0) / (x1 - x0))

    def _crossings(self, bounds: np.ndarray) -> np.ndarray:
        """Where edges cross within a slab: only in slabs whose edges are ordered differently at both sides."""
        found = [np.zeros(0)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            across = np.flatnonzero((self.edges[:, 0] <= a) & (self.edges[:, 2] >= b))
            left, right = self._y(across, a), self._y(across, b)
            order = np.lexsort((right, left))
            if (np.diff(right[order]) >= 0).all():
                continue
            d0, d1 = left[:, None] - left, right[:, None] - right
            i, j = np.nonzero((d0 < 0) & (d1 > 0))
            found.append(a + (b - a) * (d0[i, j] / (d0[i, j] - d1[i, j])))
        return np.concatenate(found)

    def locate(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of a point and region holding it, for every such pair."""
        slab = np.searchsorted(self.bounds, x, side="right") - 1
        at = np.flatnonzero((slab >= 0) & (slab < len(self.bounds) - 1))
        slab, px, py = slab[at], x[at], y[at]
        low, high = self._starts[slab], self._starts[slab + 1]
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high) // 2, 0)
            below = self._y(self._order[middle], px) < py
            low, high = np.where(open_ & below, middle + 1, low), np.where(open_ & ~below, middle, high)
        gap = low + slab
        number = self._gaps[gap + 1] - self._gaps[gap]
        point = np.repeat(at, number)
        within = np.arange(len(point)) - np.repeat(np.cumsum(number) - number, number)
        return point, self._inside[np.repeat(self._gaps[gap], number) + within]
