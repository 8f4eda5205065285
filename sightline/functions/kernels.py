"""Scores of pairs in NumPy, for rows that hold what depends on one side alone.

Operation by operation as in :mod:`sightline.functions.geometry`.  ``score(e, g)`` takes places in the
rows of the table it was made of; what it cannot score is NaN.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PARTS = [f"_c{i}{k}" for k in "xy" for i in range(4)]


def _of(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _overlap(low_a, high_a, low_b, high_b) -> np.ndarray:
    """An unknown low end is -inf and an unknown high end inf; unknown on both sides: no overlap."""
    gap = np.fmin(high_a, high_b) - np.maximum(low_a, low_b)
    return np.where(np.isinf(gap), 0.0, np.maximum(gap, 0.0))


def _iou(inter, one, two, lost) -> np.ndarray:
    union = one + two - inter
    return np.where(lost | (union <= 0), 0.0, inter / np.where(union == 0, 1.0, union))


def clipped_area(ex, ey, gx, gy) -> np.ndarray:
    """Area of convex polygons of four corners (rows) cut by counter-clockwise ones."""
    out = np.zeros(len(ex))
    x, y, count, rows = ex, ey, np.full(len(ex), 4), np.arange(len(ex))
    for k in range(4):
        ax, ay, bx, by = gx[rows, k, None], gy[rows, k, None], gx[rows, (k + 1) % 4, None], gy[rows, (k + 1) % 4, None]
        s = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        at = np.arange(x.shape[1])[None, :]
        live = at < count[:, None]
        after = np.where(at + 1 < count[:, None], at + 1, 0)
        qx, qy, qs = (np.take_along_axis(v, after, 1) for v in (x, y, s))
        here = live & (s >= 0)
        cross = live & (((s > 0) & (qs < 0)) | ((s < 0) & (qs > 0)))
        t = s / np.where(cross, s - qs, 1.0)
        ends = np.cumsum(here.astype("int8") + cross, 1)
        count = ends[:, -1].astype("int64")
        nx, ny = np.zeros((len(x), max(1, count.max(initial=0)))), np.zeros((len(x), max(1, count.max(initial=0))))
        r, c = np.nonzero(here)
        p = ends[r, c] - 1 - cross[r, c]
        nx[r, p], ny[r, p] = x[r, c], y[r, c]
        r, c = np.nonzero(cross)
        p, t = ends[r, c] - 1, t[r, c]
        nx[r, p], ny[r, p] = x[r, c] + t * (qx[r, c] - x[r, c]), y[r, c] + t * (qy[r, c] - y[r, c])
        some = count >= 3 if k == 3 else count > 0
        x, y, count, rows = nx[some], ny[some], count[some], rows[some]
        if not len(rows):
            return out
    total = np.zeros(len(rows))
    for j in range(x.shape[1]):
        last = np.where(j + 1 < count, min(j + 1, x.shape[1] - 1), 0)
        every = np.arange(len(rows))
        term = x[:, j] * y[every, last] - x[every, last] * y[:, j]
        total = np.where(j < count, total + term, total)
    out[rows] = np.abs(total) / 2
    return out


class Roi:
    larger = True
    columns = ["_left", "_right", "_top", "_bottom", "_size"]

    def __init__(self, table: pa.Table):
        self.left, self.right, self.top, self.bottom, self.size = (_of(table, c) for c in self.columns)
        self.lost = np.asarray(table.column("_size").is_null())

    def score(self, e, g, least=None):
        wide = _overlap(self.left[e], self.right[e], self.left[g], self.right[g])
        high = _overlap(self.top[e], self.bottom[e], self.top[g], self.bottom[g])
        return _iou(wide * high, self.size[e], self.size[g], self.lost[e] | self.lost[g])


class Plane:
    larger = False
    columns = PARTS

    def __init__(self, table: pa.Table):
        at = [_of(table, c) for c in PARTS]
        self.x, self.y = np.stack(at[:4]), np.stack(at[4:])
        self.near = np.sqrt(self.x * self.x + self.y * self.y).argsort(0, kind="stable")[:2]

    def score(self, e, g, least=None):
        square = np.empty((4, 4, max(len(e), len(g))))
        for i in range(4):
            for j in range(4):
                dx, dy = self.x[i, e] - self.x[j, g], self.y[i, e] - self.y[j, g]
                square[i, j] = dx * dx + dy * dy
        gap = np.sqrt(square)
        shift = np.stack([gap[k, 0] + gap[(1 + k) % 4, 1] + gap[(2 + k) % 4, 2] + gap[(3 + k) % 4, 3] for k in range(4)]).argmin(0)
        each = np.arange(square.shape[2])
        one, two = self.near[:, g]
        return np.sqrt((square[(one + shift) % 4, one, each] + square[(two + shift) % 4, two, each]) / 2)


class Bev:
    larger = True
    columns = ["_x", "_y", "_diagonal", "_size", *PARTS]
    solid = False

    def __init__(self, table: pa.Table):
        self.at, self.diagonal, self.size = np.stack([_of(table, "_x"), _of(table, "_y")]), _of(table, "_diagonal"), _of(table, "_size")
        self.lost = np.asarray(table.column("_size").is_null())
        self.x, self.y = np.stack([_of(table, c) for c in PARTS[:4]], 1), np.stack([_of(table, c) for c in PARTS[4:]], 1)
        self.nan = np.isnan(self.x).any(1) | np.isnan(self.y).any(1)
        self.wrong = self.nan & ~np.asarray(table.column("_c0x").is_null())
        self.low, self.high = np.stack([self.x.min(1), self.y.min(1)]), np.stack([self.x.max(1), self.y.max(1)])
        if self.solid:
            self.bottom, self.top = _of(table, "_bottom"), _of(table, "_top")

    def score(self, e, g, least=None):
        """Pairs that are sure to score less than ``least`` may score 0."""
        dx, dy = self.at[0, e] - self.at[0, g], self.at[1, e] - self.at[1, g]
        near = np.sqrt(dx * dx + dy * dy) <= (self.diagonal[e] + self.diagonal[g]) / 2 + 1e-9
        tall = _overlap(self.bottom[e], self.top[e], self.bottom[g], self.top[g]) if self.solid else 1.0
        sides = [np.minimum(self.high[k, e], self.high[k, g]) - np.maximum(self.low[k, e], self.low[k, g]) for k in (0, 1)]
        meet = near & (sides[0] >= 0) & (sides[1] >= 0)  # nowhere where a corner is NaN
        if least is not None:
            most = sides[0] * sides[1] * tall
            meet &= most * (1 + least) >= least * (self.size[e] + self.size[g]) * (1 - 1e-9)
        inter = np.zeros(near.shape)
        some = np.flatnonzero(meet)
        es, gs = (np.broadcast_to(v, near.shape)[some] for v in (e, g))
        inter[some] = clipped_area(self.x[es], self.y[es], self.x[gs], self.y[gs])
        inter[near & (self.wrong[e] | self.wrong[g])] = np.nan
        return _iou(inter * tall, self.size[e], self.size[g], self.lost[e] | self.lost[g])


class Solid(Bev):
    columns = [*Bev.columns, "_bottom", "_top"]
    solid = True


KERNELS = {"iou_roi": Roi, "plane_distance": Plane, "iou_bev": Bev, "iou_3d": Solid}
