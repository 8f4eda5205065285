"""Geometry of boxes and points as column expressions.

A box has flat columns ``x y z yaw w l h`` (width across, length along, height), prefixed on each side
of a join.  Everything stays inside Catalyst.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm(*parts: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, (p * p for p in parts)))


def center_distance(a: str, b: str) -> Column:
    return norm(*(F.col(a + k) - F.col(b + k) for k in "xyz"))


def bev_distance(a: str, b: str) -> Column:
    return norm(*(F.col(a + k) - F.col(b + k) for k in "xy"))


def iou(inter: Column, one: Column, two: Column) -> Column:
    union = one + two - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def _overlap(low_a, high_a, low_b, high_b) -> Column:
    return F.greatest(F.lit(0.0), F.least(high_a, high_b) - F.greatest(low_a, low_b))


def height_overlap(a: str, b: str) -> Column:
    side = lambda p, s: F.col(p + "z") + s * F.col(p + "h") / 2
    return _overlap(side(a, -1), side(a, 1), side(b, -1), side(b, 1))


def roi_iou(a: str, b: str) -> Column:
    """Of image boxes ``rx ry rh rw``: left, top, height, width."""
    c = lambda p, k: F.col(p + k).cast("double")
    wide = _overlap(c(a, "rx"), c(a, "rx") + c(a, "rw"), c(b, "rx"), c(b, "rx") + c(b, "rw"))
    high = _overlap(c(a, "ry"), c(a, "ry") + c(a, "rh"), c(b, "ry"), c(b, "ry") + c(b, "rh"))
    return iou(wide * high, c(a, "rw") * c(a, "rh"), c(b, "rw") * c(b, "rh"))


def _corners(p: str, full: bool) -> tuple[list[tuple[Column, Column]], Column]:
    """((x, y) of the corners, whether they run clockwise)."""
    if full:
        x, y, z, w = (F.col(f"{p}q{k}") for k in "xyzw")
        n = x * x + y * y + z * z + w * w
        axes = (1 - 2 * (y * y + z * z) / n, 2 * (x * y - z * w) / n, 2 * (x * y + z * w) / n, 1 - 2 * (x * x + z * z) / n)
    else:
        cos, sin = F.cos(p + "yaw"), F.sin(p + "yaw")
        axes = (cos, -sin, sin, cos)
    out = []
    for u, v in ((1, 1), (-1, 1), (-1, -1), (1, -1)):
        along, across = u * F.col(p + "l") / 2, v * F.col(p + "w") / 2
        out.append((F.col(p + "x") + along * axes[0] + across * axes[1], F.col(p + "y") + along * axes[2] + across * axes[3]))
    return out, axes[0] * axes[3] - axes[1] * axes[2] < 0


def corners(p: str, full: bool = False) -> Column:
    """Footprint corners, front left first, counter-clockwise.

    By the yaw, or with ``full`` by the whole rotation ``qx qy qz qw``, seen from above.
    """
    points, clockwise = _corners(p, full)
    points = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in points))
    # A box that stands on its head is seen clockwise.
    return F.when(clockwise, F.reverse(points)).otherwise(points) if full else points


def _next(points: Column, i: Column) -> Column:
    return F.element_at(points, (i + 1) % F.size(points) + 1)


def readied(score: str, full: bool = False) -> dict[str, Column]:
    """What :mod:`sightline.functions.kernels` reads of a row; an unknown end of a range is infinite."""
    low, high = (lambda c, x=x: F.coalesce(c.cast("double"), F.lit(x)) for x in (-math.inf, math.inf))
    if score == "iou_roi":
        c = lambda k: F.col(k).cast("double")
        return {"_left": low(c("rx")), "_right": high(c("rx") + c("rw")), "_top": low(c("ry")), "_bottom": high(c("ry") + c("rh")), "_size": c("rw") * c("rh")}
    points = canonical("", full) if score == "plane_distance" else corners("", full)
    out = {f"_c{i}{k}": F.get(F.col("_points"), F.lit(i))[k] for k in "xy" for i in range(4)}
    if score == "plane_distance":
        return {"_points": points, **out}
    out |= {"_x": F.col("x"), "_y": F.col("y"), "_diagonal": norm(F.col("l"), F.col("w"))}
    if score == "iou_bev":
        return {"_points": points, **out, "_size": F.col("w") * F.col("l")}
    end = lambda s: F.col("z") + s * F.col("h") / 2
    return {"_points": points, **out, "_size": F.col("w") * F.col("l") * F.col("h"), "_bottom": low(end(-1)), "_top": high(end(1))}


def polygon_area(points: Column) -> Column:
    def area(points: Column) -> Column:
        cross = F.transform(points, lambda a, i: a.x * _next(points, i).y - _next(points, i).x * a.y)
        return F.when(F.size(points) < 3, 0.0).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2)

    return let(points, area)


def clip(subject: Column, window: Column) -> Column:
    """Intersection of a convex polygon with a convex counter-clockwise one of four corners."""
    edges = let(window, lambda w: F.transform(w, lambda a, i: F.struct(a.x.alias("ax"), a.y.alias("ay"), _next(w, i).x.alias("bx"), _next(w, i).y.alias("by"))))
    none = F.expr("CAST(array() AS array<struct<x: double, y: double>>)")

    def side(e: Column, p: Column) -> Column:
        return (e.bx - e.ax) * (p.y - e.ay) - (e.by - e.ay) * (p.x - e.ax)

    def cut(points: Column, e: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            q = F.element_at(a, (i + 1) % F.size(a) + 1)
            p = F.element_at(a, i + 1)
            k = p.s / (p.s - q.s)
            cross = F.struct((p.x + k * (q.x - p.x)).alias("x"), (p.y + k * (q.y - p.y)).alias("y"))
            here = F.when(p.s >= 0, F.array(F.struct(p.x.alias("x"), p.y.alias("y")))).otherwise(none)
            return F.concat(here, F.when(((p.s > 0) & (q.s < 0)) | ((p.s < 0) & (q.s > 0)), F.array(cross)).otherwise(none))

        sided = F.transform(points, lambda p: F.struct(p.x.alias("x"), p.y.alias("y"), side(e, p).alias("s")))
        return let(sided, lambda a: F.flatten(F.transform(a, lambda _, i: step(a, i))))

    return F.aggregate(edges, subject, cut)


def bev_intersection(a: str, b: str, full: bool = False) -> Column:
    """Common area of two footprints; boxes too far apart to touch are not clipped."""
    reach = (norm(F.col(a + "l"), F.col(a + "w")) + norm(F.col(b + "l"), F.col(b + "w"))) / 2
    return F.when(bev_distance(a, b) <= reach + 1e-9, polygon_area(clip(corners(a, full), corners(b, full)))).otherwise(0.0)


def bev_iou(a: str, b: str, full: bool = False) -> Column:
    return iou(bev_intersection(a, b, full), F.col(a + "w") * F.col(a + "l"), F.col(b + "w") * F.col(b + "l"))


def volume_iou(a: str, b: str, full: bool = False) -> Column:
    size = lambda p: F.col(p + "w") * F.col(p + "l") * F.col(p + "h")
    return iou(bev_intersection(a, b, full) * height_overlap(a, b), size(a), size(b))


def _gap(p: Column, q: Column) -> Column:
    return norm(p.x - q.x, p.y - q.y)


def corner_displacement(a: str, b: str, full: bool = False) -> Column:
    """Least mean distance of corners over the four ways to start counting."""
    one, two = _corners(a, full)[0], _corners(b, full)[0]
    gap = [[norm(one[i][0] - two[j][0], one[i][1] - two[j][1]) for j in range(4)] for i in range(4)]
    return F.least(*(sum((gap[i][(i + k) % 4] for i in range(4)), F.lit(0.0)) / 4 for k in range(4)))


def heading_error(a: Column, b: Column) -> Column:
    """Shortest angle between two yaws, 0 to pi; null where either is unknown."""
    return F.abs(F.pmod(a - b + F.lit(PI), F.lit(2 * PI)) - F.lit(PI))


def yaw_of(q: str) -> Column:
    """Yaw of a unit quaternion in columns qx qy qz qw."""
    x, y, z, w = (F.col(f"{q}q{k}") for k in "xyzw")
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def canonical(p: str, full: bool = False) -> Column:
    """Footprint corners by their direction from the center."""
    pts = corners(p, full)
    return F.transform(F.array_sort(F.transform(pts, lambda c, i: F.struct(F.atan2(c.y - F.col(p + "y"), c.x - F.col(p + "x")).alias("t"), i.alias("i"), c.alias("c")))), lambda s: s.c)


def plane_distance(a: str, gt: str, full: bool = False) -> Column:
    """RMS gap of the two footprint corners that are nearest to the origin in ``gt``."""

    def shifted(s: Column) -> Column:
        gaps = F.array(*(F.struct(sum((_gap(s.one[(i + k) % 4], s.two[i]) for i in range(4)), F.lit(0.0)).alias("s"), F.lit(k).alias("k")) for k in range(4)))
        near = F.array_sort(F.transform(s.two, lambda c, i: F.struct(norm(c.x, c.y).alias("d"), i.alias("i"))))
        return F.struct(s.one.alias("one"), s.two.alias("two"), F.array_min(gaps).k.alias("shift"), near[0].i.alias("i"), near[1].i.alias("j"))

    def face(s: Column) -> Column:
        def pair(i: Column) -> Column:
            p, q = F.element_at(s.one, (i + s.shift) % 4 + 1), F.element_at(s.two, i + 1)
            return (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)

        return F.sqrt((pair(s.i) + pair(s.j)) / 2)

    return let(let(F.struct(canonical(a, full).alias("one"), canonical(gt, full).alias("two")), shifted), face)


def _crossings(x: Column, y: Column, polygon: list[tuple[float, float]]) -> tuple[Column, Column]:
    """(edges crossed to the right of a point, whether it lies on an edge)."""
    odd, on = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1]):
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        on = on | ((cross == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
        if y1 != y2:
            spans = (y >= min(y1, y2)) & (y < max(y1, y2))
            odd = odd + (spans & (x < x1 + (y - y1) * (x2 - x1) / (y2 - y1))).cast("int")
    return odd, on


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]], edge: bool) -> Column:
    """Crossing-number test; points on the boundary count as ``edge`` says."""
    odd, on = _crossings(x, y, polygon)
    return on | (odd % 2 == 1) if edge else ~on & (odd % 2 == 1)


#: Directions and distance at which the surroundings of a point on an edge are looked at.
NUDGES = [(1e-7 * math.cos(0.1 + k * PI / 8), 1e-7 * math.sin(0.1 + k * PI / 8)) for k in range(16)]


def in_union(x: Column, y: Column, polygons: list[list[tuple[float, float]]]) -> Column:
    """Inside the union of polygons, its outline excluded; an edge between two of them is inside."""

    def strictly(x: Column, y: Column) -> tuple[Column, Column]:
        parts = [_crossings(x, y, p) for p in polygons]
        inside = [~on & (odd % 2 == 1) for odd, on in parts]
        return reduce(lambda a, b: a | b, inside, F.lit(False)), reduce(lambda a, b: a | b, (on for _, on in parts), F.lit(False))

    inside, on = strictly(x, y)
    around = F.array(*(F.struct(F.lit(dx).alias("x"), F.lit(dy).alias("y")) for dx, dy in NUDGES))
    return F.when(inside, True).when(on, F.forall(around, lambda d: strictly(x + d.x, y + d.y)[0])).otherwise(F.lit(False))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """(inside, on) of a ring ``array<struct<x,y>>`` in a column: strictly inside, on an edge."""
    n = F.size(ring)

    def edge(got: Column, i: Column) -> Column:
        p, q = F.element_at(ring, i + 1), F.element_at(ring, (i + 1) % n + 1)
        cross = (q.x - p.x) * (y - p.y) - (q.y - p.y) * (x - p.x)
        on = (cross == 0) & x.between(F.least(p.x, q.x), F.greatest(p.x, q.x)) & y.between(F.least(p.y, q.y), F.greatest(p.y, q.y))
        spans = (y >= F.least(p.y, q.y)) & (y < F.greatest(p.y, q.y))
        left = F.when(spans, x < p.x + (y - p.y) * (q.x - p.x) / F.nullif(q.y - p.y, F.lit(0.0))).otherwise(F.lit(False))
        return F.struct((got.inside != left).alias("inside"), (got.on | on).alias("on"))

    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("on"))
    return F.aggregate(F.sequence(F.lit(0), n - 1), start, edge, lambda g: F.struct((g.inside & ~g.on).alias("inside"), g.on.alias("on")))


def bev_area(p: str = "") -> Column:
    return F.col(p + "w") * F.col(p + "l")


def volume(p: str = "") -> Column:
    return bev_area(p) * F.col(p + "h")


def roi_area(p: str = "") -> Column:
    return F.col(p + "rw") * F.col(p + "rh")
