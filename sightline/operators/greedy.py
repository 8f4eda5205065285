"""Greedy assignment within groups of rows, in memory that grows with the group and not with its pairs.

Estimates take their turn, surest first; each takes its best free ground truth.  For distances free
ground truth lies in blocks of neighbours, of which an estimate reads those that can hold its best.
The arithmetic is that of :mod:`sightline.functions.geometry`, operation by operation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sightline.functions.kernels import KERNELS

#: Places in a block, as many as need no blocks, those looked up at once, and what a bound may lose by rounding.
BLOCK, FLAT, SEEN, SLACK = 64, 512, 32, 1 + 1e-9
#: Pairs that are scored at once, and scores kept for later estimates at a place.
AT_ONCE, KEPT = 1 << 16, 128


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; null equals null, NaN equals NaN."""
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    differ = pc.fill_null(pc.not_equal(a, b), False)
    if pa.types.is_floating(column.type):
        differ = pc.and_(differ, pc.invert(pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False)))
    return pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with one key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            if any(_changes(pa.concat_arrays([last.column(k), batch.column(k).slice(0, 1)]))[0] for k in key):
                yield pa.Table.from_batches(held)
                held = []
        start = 0
        for stop in np.flatnonzero(np.logical_or.reduce([_changes(batch.column(k)) for k in key])) + 1:
            held.append(batch.slice(start, stop - start))
            yield pa.Table.from_batches(held)
            held, start = [], stop
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _in_blocks(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Points in an order in which each run of ``BLOCK`` lies close together: strips along x, cut along y."""
    strips = max(1, round(math.sqrt(len(x) / BLOCK)))
    wide = -(-len(x) // (strips * BLOCK)) * BLOCK
    order = np.argsort(x, kind="stable")
    return order[np.lexsort((y[order], np.arange(len(x)) // wide))]


def nearest(est: np.ndarray, gt: np.ndarray, limit: np.ndarray, deep: bool, gate: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(ground truth that each estimate takes or -1, its distance); both sides are columns x y z.

    Distances over the plane, or with ``deep`` in space; ``gate`` bounds those in space.  Equally near:
    the earlier ground truth.
    """
    took, score = np.full(len(est), -1), np.full(len(est), np.nan)
    used = 3 if deep or gate is not None else 2
    free = np.flatnonzero(~np.isnan(gt[:, :used]).any(1))
    if not len(free):
        return took, score
    widest = limit[free].max()
    cap = widest if gate is None else min(widest, gate)
    if not np.isfinite(cap) and not (np.isfinite(est[:, :used]).all() and np.isfinite(gt[free, :used]).all()):

        def measure(e, g):
            s = _apart(est[e].T, gt[g].T, deep, gate)
            space = s if gate is None else _apart(est[e].T, gt[g].T, True, None)
            return np.where((s <= limit[g]) & (gate is None or space <= gate), s, np.nan)

        return best_free(len(est), len(gt), measure, limit)
    free = free[np.isfinite(gt[free, :used]).all(1)]
    turns = np.flatnonzero(np.isfinite(est[:, :used]).all(1))
    if not len(free) or not len(turns):
        return took, score
    field = _Field(est, gt[:, :used], limit, free, cap, deep, gate)
    return _in_turn(field, turns, list(est[:, :used].T), took, score)


def _in_turn(field: _Lines, turns: np.ndarray, columns: list[np.ndarray], took: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fill in what each estimate takes; estimates with the same ``columns`` share a look around."""
    starts, order = _places([c[turns] for c in columns])
    spot = np.empty(len(turns), "int64")
    spot[order] = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    waiting = np.diff(starts).tolist()  # estimates at a place, which see the same ground truth
    seen: dict[int, list] = {}
    for i, at in zip(turns.tolist(), spot.tolist()):
        waiting[at] -= 1
        view = seen.pop(at, None)
        while True:
            if view is None:
                view = [*field.around(i, SEEN if waiting[at] else 1), 0]
            scores, places, whole, k = view
            while k < len(places) and field.empty(places[k]):
                k += 1
            if k < len(places) or whole:
                break
            view = None
        view[3] = k
        if waiting[at]:
            seen[at] = view
        if k == len(places):
            continue
        best = scores[k]
        g, place = field.first(places[k]), places[k]
        for j in range(k + 1, len(places)):
            if scores[j] != best:
                break
            if not field.empty(places[j]) and field.first(places[j]) < g:
                g, place = field.first(places[j]), places[j]
        took[i], score[i] = g, best
        field.take(place)
    return took, score


class _Lines:
    """Free ground truth by place.  At one place (and of one limit) it waits in a line, the earliest first."""

    def __init__(self, columns: list[np.ndarray], limit: np.ndarray, free: np.ndarray):
        self.even = bool((limit[free] == limit[free[0]]).all())
        starts, order = _places([*(c[free] for c in columns), *([] if self.even else [limit[free]])])
        self.line, self.head, self.ends = free[order].tolist(), starts[:-1].tolist(), starts[1:].tolist()
        self.shown = free[order[starts[:-1]]]
        self.gone = np.zeros(len(self.head), bool)

    def empty(self, place: int) -> bool:
        return self.head[place] == self.ends[place]

    def first(self, place: int) -> int:
        return self.line[self.head[place]]

    def take(self, place: int) -> None:
        self.head[place] += 1
        if self.head[place] == self.ends[place]:
            self.gone[place] = True
            self.emptied(place)


class _Field(_Lines):
    def __init__(self, est, gt, limit, free, cap, deep, gate):
        super().__init__(list(gt.T), limit, free)
        self.est, self.cap, self.deep, self.gate = est, cap, deep, gate
        self.at, self.most = gt[self.shown], limit[self.shown]
        self.where, self.held = np.zeros(len(self.head), "int64"), np.arange(len(self.head))
        self._build()

    def _build(self) -> None:
        self.held = self.held[~self.gone[self.held]]
        self.built = self.left = len(self.held)
        self.size = max(1, self.built) if self.built <= FLAT else BLOCK
        order = self.held if self.built <= FLAT else self.held[_in_blocks(self.at[self.held, 0], self.at[self.held, 1])]
        pad = -len(order) % self.size
        self.where[order] = np.arange(len(order))
        filled = lambda c, x: np.concatenate([c[order], np.full(pad, x, c.dtype)]).reshape(-1, self.size)
        self.place = filled(np.arange(len(self.head)), -1)
        self.axes = [filled(c, np.inf) for c in self.at.T]
        self.limits = None if self.even else filled(self.most, -np.inf)
        self.low, self.high = [c.min(1) for c in self.axes[:2]], [np.where(np.isinf(c), -np.inf, c).max(1) for c in self.axes[:2]]
        self.count = np.isfinite(self.axes[0]).sum(1)

    def emptied(self, place: int) -> None:
        spot = self.where[place]
        self.axes[0].flat[spot] = np.inf
        self.left -= 1
        self.count[spot // self.size] -= 1
        if not self.count[spot // self.size]:
            self.low[0][spot // self.size] = np.inf
        if self.left * 2 <= self.built:
            self._build()

    def _measure(self, one: np.ndarray, rows) -> np.ndarray:
        s = _apart(one, [c[rows] for c in self.axes], self.deep, self.gate)
        return s if self.even else np.where(s <= self.limits[rows], s, np.inf)

    def around(self, i: int, many: int) -> tuple[list, list, bool]:
        """(distances, places, whether these are all) of at least ``many`` places in reach, if there are, from near to far."""
        one = self.est[i]
        if not self.left:
            return [], [], True
        first = 0
        if len(self.count) > 1:
            across = np.maximum(np.maximum(self.low[0] - one[0], one[0] - self.high[0]), 0.0)
            along = np.maximum(np.maximum(self.low[1] - one[1], one[1] - self.high[1]), 0.0)
            bound = across * across + along * along
            first = int(bound.argmin())
        s = self._measure(one, first)
        p = self.place[first]
        reach = self.cap
        if len(self.count) > 1:
            reach = min(self.cap, np.partition(s, many - 1)[many - 1] if many > 1 else s.min())
            bound[first] = np.inf
            more = np.flatnonzero(bound <= reach * reach * SLACK + 1e-300)
            if len(more):
                s, p = np.concatenate([s, self._measure(one, more).ravel()]), np.concatenate([p, self.place[more].ravel()])
        if len(s) > many:
            reach = min(reach, np.partition(s, many - 1)[many - 1] if many > 1 else s.min())
        near = np.flatnonzero((s <= reach) & (s < np.inf))
        near = near[s[near].argsort(kind="stable")] if len(near) > 1 else near
        return s[near].tolist(), p[near].tolist(), reach == self.cap


def _apart(one: np.ndarray, many, deep: bool, gate: float | None) -> np.ndarray:
    dx, dy = one[0] - many[0], one[1] - many[1]
    square = dx * dx + dy * dy
    if gate is None and not deep:
        return np.sqrt(square)
    dz = one[2] - many[2]
    space = np.sqrt(square + dz * dz)
    s = space if deep else np.sqrt(square)
    return s if gate is None else np.where(space <= gate, s, np.inf)


def _places(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(starts of runs and their end, rows in runs of equal values); a run keeps the rows' order."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return np.concatenate([[0], np.flatnonzero(new), [len(order)]]), order


def _apart(one: np.ndarray, many, deep: bool, gate: float | None) -> np.ndarray:
    dx, dy = one[0] - many[0], one[1] - many[1]
    square = dx * dx + dy * dy
    if gate is None and not deep:
        return np.sqrt(square)
    dz = one[2] - many[2]
    space = np.sqrt(square + dz * dz)
    s = space if deep else np.sqrt(square)
    return s if gate is None else np.where(space <= gate, s, np.inf)


class _Scan(_Lines):
    """Any score: a look around measures all places that are left, for as many estimates as AT_ONCE pairs allow."""

    def __init__(self, measure: Callable[[np.ndarray, np.ndarray], np.ndarray], columns, limit, free, firsts):
        super().__init__(columns, limit, free)
        self.measure, self.left, self.firsts, self.ready = measure, np.arange(len(self.head)), firsts, {}

    def emptied(self, place: int) -> None:
        if self.gone[self.left].sum() * 2 >= len(self.left):
            self.left = self.left[~self.gone[self.left]]

    def around(self, i: int, many: int) -> tuple[list, list, bool]:
        if i not in self.ready:
            self.left = self.left[~self.gone[self.left]]
            if not len(self.left):
                return [], [], True
            at = int(np.searchsorted(self.firsts, i))
            ahead = self.firsts[at : at + max(1, AT_ONCE // len(self.left))] if at < len(self.firsts) and self.firsts[at] == i else np.array([i])
            s = self.measure(np.repeat(ahead, len(self.left)), np.tile(self.shown[self.left], len(ahead)))
            near = np.flatnonzero(~np.isnan(s))
            of, s = near // len(self.left), s[near]
            order = np.lexsort((s, of))
            s, places = s[order], self.left[near[order] % len(self.left)]
            ends = np.searchsorted(of, np.arange(len(ahead) + 1))
            self.ready = {e: (s[a:b], places[a:b]) for e, a, b in zip(ahead.tolist(), ends[:-1].tolist(), ends[1:].tolist())}
        s, places = self.ready.pop(i)
        # What is kept for later estimates is cut, but not between equal scores.
        stop = len(s) if many == 1 or len(s) <= KEPT else int(np.searchsorted(s, s[KEPT - 1], "right"))
        return s[:stop].tolist(), places[:stop].tolist(), stop == len(s)


def best_free(n: int, many: int, measure: Callable[[np.ndarray, np.ndarray], np.ndarray], limit: np.ndarray, est: list | None = None, gt: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`nearest` for any cost: ``measure(e, g)`` of rows of both sides, NaN where a pair is not feasible.

    ``est`` and ``gt`` are columns that tell apart what costs differently (default: the rows).
    """
    took, score = np.full(n, -1), np.full(n, np.nan)
    if not n or not many:
        return took, score
    columns = est or [np.arange(n)]
    starts, order = _places(columns)
    field = _Scan(measure, gt or [np.arange(many)], limit, np.arange(many), np.sort(order[starts[:-1]]))
    return _in_turn(field, np.arange(n), columns, took, score)


def assign_groups(batches: Iterator[pa.RecordBatch], key: list[str], out: list[str], kind: str, gate: float | None, cuts: tuple | None) -> Iterator[pa.RecordBatch]:
    """(``out``, cut, e, g, score) of rows ``key _gt id sure limit`` and coordinates, sorted by ``key``."""
    for group in groups(batches, key):
        side = group.column("_gt").to_numpy()
        est, gt = np.flatnonzero(~side), np.flatnonzero(side)
        if not len(est) or not len(gt):
            continue
        ids, sure, limit = (group.column(c).to_numpy() for c in ("_id", "_sure", "_limit"))
        est, gt = est[np.lexsort((-ids[est], sure[est]))], gt[np.argsort(ids[gt], kind="stable")]
        _agree(group, est, gt, gate)
        rows = KINDS[kind](group, est, gt, gate)
        for cut in cuts or (None,):
            most = limit[gt] if cut is None else rows.stricter(limit[gt], cut)
            took, score = rows(most)
            hit = np.flatnonzero(took >= 0)
            if not len(hit):
                continue
            columns = [group.column(k).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(hit), "int64"))) for k in out]
            columns += [pa.array(np.full(len(hit), cut, "float64"))] if cuts else []
            columns += [pa.array(ids[est[hit]]), pa.array(ids[gt[took[hit]]]), pa.array(score[hit])]
            yield pa.RecordBatch.from_arrays(columns, [*out, *(["cut"] if cuts else []), "e", "g", "score"])


def _agree(group: pa.Table, est: np.ndarray, gt: np.ndarray, gate: float | None) -> None:
    """Estimates and ground truth of a group that state different coordinate frames raise."""
    if "_coords" not in group.column_names:
        return
    stated = group.column("_coords").to_numpy()
    e, g = ({x for x in stated[rows] if x is not None} for rows in (est, gt))
    if e and g and len(e | g) > 1:
        raise ValueError("pairs across coordinate frames")


class Distance:
    larger = False

    def __init__(self, group, est, gt, gate, deep=False):
        at = np.stack([group.column(k).to_numpy() for k in ("_x", "_y", "_z") if k in group.column_names], 1)
        self.est, self.gt, self.gate, self.deep = at[est], at[gt], gate, deep

    def stricter(self, limit, cut):
        return np.maximum(limit, cut) if self.larger else np.minimum(limit, cut)

    def __call__(self, limit):
        return nearest(self.est, self.gt, limit, self.deep, self.gate)


class Spatial(Distance):
    def __init__(self, group, est, gt, gate):
        super().__init__(group, est, gt, gate, True)


class Scored(Distance):
    """A score by its kernel."""

    def __init__(self, group, est, gt, gate, kernel):
        self.kernel, self.e, self.g, self.larger = kernel(group), est, gt, kernel.larger
        self.columns = [group.column(c).to_numpy() for c in kernel.columns]
        self.gate, self.at = gate, None if gate is None else [group.column(k).to_numpy() for k in ("_x", "_y", "_z")]
        self.columns += self.at or []

    def __call__(self, limit):
        def measure(turns, rows):
            e, g = self.e[turns], self.g[rows]
            s = self.kernel.score(e, g, limit[rows] if self.larger else None)
            ok = s >= limit[rows] if self.larger else s <= limit[rows]
            if self.gate is not None:
                dx, dy, dz = (c[e] - c[g] for c in self.at)
                ok &= np.sqrt(dx * dx + dy * dy + dz * dz) <= self.gate
            return np.where(ok, -s if self.larger else s, np.nan)

        took, cost = best_free(len(self.e), len(self.g), measure, limit, [c[self.e] for c in self.columns], [c[self.g] for c in self.columns])
        return took, -cost if self.larger else cost


KINDS = {"bev_distance": Distance, "center_distance": Spatial, **{k: partial(Scored, kernel=kernel) for k, kernel in KERNELS.items()}}


def score_groups(batches: Iterator[pa.RecordBatch], key: list[str], out: list[str], kind: str) -> Iterator[pa.RecordBatch]:
    """(``out``, e, g, score) of all pairs of a group, some at a time."""
    for group in groups(batches, key):
        side, ids = group.column("_gt").to_numpy(), group.column("_id").to_numpy()
        est, gt = np.flatnonzero(~side), np.flatnonzero(side)
        if not len(est) or not len(gt):
            continue
        kernel = KERNELS[kind](group)
        for start in range(0, len(est), max(1, AT_ONCE // len(gt))):
            some = est[start : start + max(1, AT_ONCE // len(gt))]
            for g in np.array_split(gt, -(-len(gt) // AT_ONCE)):
                e, other = np.repeat(some, len(g)), np.tile(g, len(some))
                columns = [group.column(k).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(e), "int64"))) for k in out]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids[e]), pa.array(ids[other]), pa.array(kernel.score(e, other))], [*out, "e", "g", "score"])


def assign_pairs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.RecordBatch]:
    """Of pairs ``key _sure _turn s g``, sorted so, those that are matched; held are only a group's matched rows."""
    last, done, taken = None, None, set()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for k in key:
            new[1:] |= _changes(batch.column(k))
            new[0] |= last is None or bool(_changes(pa.concat_arrays([last.column(k), batch.column(k).slice(0, 1)]))[0])
        picked = []
        for i, (fresh, e, g) in enumerate(zip(new.tolist(), batch.column("_turn").to_pylist(), batch.column("g").to_pylist())):
            if fresh:
                done, taken = None, set()
            if e != done and g not in taken:
                done = e
                taken.add(g)
                picked.append(i)
        last = batch.slice(n - 1)
        if picked:
            yield batch.take(pa.array(picked))
