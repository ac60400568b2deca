"""Nearest nodes in memory: a flat grid of cells, looked at in squares around a point."""

from __future__ import annotations

import numpy as np


class Nearest:
    """Nodes by cells of a grid of some two nodes a cell, rows of cells one after another."""

    def __init__(self, ids: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> None:
        n = len(ids)
        self.x0, self.y0 = (float(v.min()) if n else 0.0 for v in (lon, lat))
        wide, high = (float(v.max()) - low if n else 0.0 for v, low in ((lon, self.x0), (lat, self.y0)))
        self.size = max(float(np.sqrt(2.0 * max(wide, 1e-6) * max(high, 1e-6) / max(n, 1))), max(wide, high) / 4096, 1e-6)
        self.cols, self.rows = int(wide / self.size) + 1, int(high / self.size) + 1
        col, row = ((v - low) // self.size for v, low in ((lon, self.x0), (lat, self.y0)))
        cell = np.minimum(row, self.rows - 1).astype(np.int64) * self.cols + np.minimum(col, self.cols - 1).astype(np.int64)
        order = np.lexsort((ids, cell))
        self.ids, self.lon, self.lat = ids[order], lon[order], lat[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=self.rows * self.cols))])

    def find(self, x: float, y: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, squared distances, places) of the k nearest nodes in planar degrees, ties by id; all, if there are fewer."""
        if not len(self.ids):
            return self.ids, np.zeros(0), np.zeros(0, np.int64)
        col, row = (int((v - low) // self.size) for v, low in ((x, self.x0), (y, self.y0)))
        # for a point outside, the square must reach the grid at least
        around = max(1, -col, col - self.cols + 2, -row, row - self.rows + 2)
        while True:
            at = self._square(col, row, around)
            whole = col - around <= 0 and row - around <= 0 and col + around >= self.cols - 1 and row + around >= self.rows - 1
            if len(at) >= k or whole:
                d2 = (self.lon[at] - x) ** 2 + (self.lat[at] - y) ** 2
                best = np.lexsort((self.ids[at], d2))[:k]
                # what lies outside the square is at least this far off, less what rounding may hide
                reach = around * self.size * (1 - 1e-9)
                if whole or d2[best[-1]] < reach * reach:
                    return self.ids[at[best]], d2[best], at[best]
                around = max(2 * around, int(np.sqrt(d2[best[-1]]) / self.size) + 2) if len(at) < 64 * k else int(np.sqrt(d2[best[-1]]) / self.size) + 2
            else:
                around *= 2

    def _square(self, col: int, row: int, around: int) -> np.ndarray:
        """Places of the nodes in the cells up to `around` cells away."""
        a, b = max(col - around, 0), min(col + around, self.cols - 1)
        if a > b:
            return np.zeros(0, np.int64)
        rows = range(max(row - around, 0), min(row + around, self.rows - 1) + 1)
        spans = [np.arange(self.first[r * self.cols + a], self.first[r * self.cols + b + 1]) for r in rows]
        return np.concatenate(spans) if spans else np.zeros(0, np.int64)
