"""Predicates that mark rows, and what is done with marks.

A predicate is a column; a mask is a table ``frame row_idx mask`` (with ``recording`` where its source has it) with one row for each row of its
source, so masks can be stored, combined and applied later.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.geometry import NUDGES, in_polygon, in_ring, in_union, norm
from sightline.functions.keys import frame_key
from sightline.functions.labels import LabelRegistry

TWO_PI = 2 * math.pi
#: Tasks that share the rows of one cell of a map.
SHARES = 64


def _span(low: float, high: float) -> None:
    if low > high:
        raise ValueError(f"empty range {low}..{high}")


def by_distance(low: float = 0.0, high: float = math.inf, bev: bool = False) -> Column:
    _span(low, high)
    return norm(*(F.col(k) for k in ("xy" if bev else "xyz"))).between(low, high)


def by_region(min_xy: tuple = (-math.inf, -math.inf), max_xy: tuple = (math.inf, math.inf), polygon: list | None = None) -> Column:
    """Inside a box, its edges included, and a polygon, likewise."""
    inside = F.col("x").between(min_xy[0], max_xy[0]) & F.col("y").between(min_xy[1], max_xy[1])
    return inside & in_polygon(F.col("x"), F.col("y"), polygon, True) if polygon else inside


def by_polar_grid(low: float = 0.0, high: float = math.inf, min_angle: float = -math.pi, max_angle: float = math.pi) -> Column:
    """Radius in range, azimuth on the arc from ``min_angle`` counter-clockwise to ``max_angle``."""
    _span(low, high)
    if not 0 <= max_angle - min_angle <= TWO_PI + 1e-9:
        raise ValueError("the arc must be 0 to 2 pi wide")
    turn = F.pmod(F.atan2("y", "x") - F.lit(min_angle), F.lit(TWO_PI))
    turn = F.when(turn >= TWO_PI - 1e-9, 0.0).otherwise(turn)
    return norm(F.col("x"), F.col("y")).between(low, high) & (turn <= max_angle - min_angle + 1e-9)


def by_map(polygons: list[list[tuple[float, float]]] | None, x: str = "x", y: str = "y") -> Column:
    """Inside the union of polygons, its outline excluded; None passes everything, no polygon nothing.

    The polygons become part of the expression, so they are few; :func:`in_map` joins any number.
    """
    return F.lit(True) if polygons is None else in_union(F.col(x), F.col(y), polygons)


def in_map(rows: DataFrame, lanes: DataFrame, cell: float = 50.0) -> DataFrame:
    """Mask of rows whose ``x y`` lie inside the union of ``lanes(ring)``, its outline excluded.

    Rings are dealt to the cells that their bounds touch and meet the rows of these by an equi-join.
    Without a ring nothing passes.
    """
    key = [*frame_key(rows), "row_idx"]
    at = lambda c: F.floor(c / cell).cast("long")
    span = lambda k: F.sequence(at(F.array_min(F.transform("ring", lambda p: p[k]))), at(F.array_max(F.transform("ring", lambda p: p[k]))))
    dealt = lanes.select("ring", F.explode(span("x")).alias("cx"), F.lit(0).alias("_")).select("ring", "cx", F.explode(span("y")).alias("cy"))
    # The rows of a cell go to SHARES tasks, and its rings to each of them: a crowded cell would be one task's.
    dealt = dealt.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    own = rows.select(*key, "x", "y", at(F.col("x")).alias("cx"), at(F.col("y")).alias("cy"), F.pmod(F.xxhash64(*key), F.lit(SHARES)).cast("int").alias("share"))
    near = own.join(dealt, ["cx", "cy", "share"]).withColumn("at", in_ring(F.col("x"), F.col("y"), F.col("ring")))
    # Of a point on an edge, which of the places around it (bits) the ring holds.
    around = F.array(*(F.struct(F.lit(1 << i).alias("bit"), F.lit(dx).alias("x"), F.lit(dy).alias("y")) for i, (dx, dy) in enumerate(NUDGES)))
    bits = F.aggregate(around, F.lit(0), lambda got, d: got + F.when(in_ring(F.col("x") + d.x, F.col("y") + d.y, F.col("ring")).inside, d.bit).otherwise(0))
    near = near.select(*key, F.col("at.inside").alias("inside"), F.when(F.col("at.on"), bits).otherwise(0).alias("bits"))
    hit = near.groupBy(*key).agg((F.bool_or("inside") | (F.bit_or("bits") == (1 << len(NUDGES)) - 1)).alias("hit"))
    return own.select(*key).join(hit, key, "left").select(*key, F.coalesce("hit", F.lit(False)).alias("mask"))


def by_label(only: list | None = None, exclude: list | None = None, column: str = "class", labels: LabelRegistry | None = None) -> Column:
    """Classes in ``only`` and not in ``exclude``; with a registry, a name that it lacks raises."""
    if only is not None and not only:
        raise ValueError("nothing is allowed")
    if labels is not None:
        for name in [*(only or []), *(exclude or [])]:
            labels.class_id(name)
    keep = F.col(column).isin(only) if only is not None else F.lit(True)
    return keep & ~F.col(column).isin(exclude) if exclude else keep


def by_instance(only: list | None = None, exclude: list | None = None) -> Column:
    return by_label(only, exclude, "instance")


def by_confidence(low: float = 0.0, high: float = 1.0) -> Column:
    if not 0 <= low <= high <= 1:
        raise ValueError("bounds lie in 0..1")
    return F.col("confidence").between(low, high)


def by_speed(low: float = 0.0, high: float = math.inf) -> Column:
    """An unknown velocity (NaN or null) does not pass."""
    speed = norm(*(F.col(k) for k in ("vx", "vy", "vz")))
    return F.coalesce(speed.between(low, high) & ~F.isnan(speed), F.lit(False))


def by_num_points(low: int = 0, high: int | None = None) -> Column:
    keep = F.col("num_points") >= low
    return keep & (F.col("num_points") <= high) if high is not None else keep


def by_visibility(least: int = 0) -> Column:
    """Unknown visibility (-1) passes."""
    if least < 0:
        raise ValueError("unknown is no level")
    return (F.col("visibility") == -1) | (F.col("visibility") >= least)


def mask(rows: DataFrame, predicate: Column) -> DataFrame:
    return rows.select(*frame_key(rows), "row_idx", predicate.alias("mask"))


def combine(masks: list[DataFrame], mode: str = "all") -> DataFrame:
    """AND or OR of masks over the same rows; a row that one of them lacks raises."""
    if mode not in ("all", "any"):
        raise ValueError(mode)
    key = [*frame_key(*masks), "row_idx"]
    named = reduce(lambda a, b: a.unionByName(b), masks)
    fold = F.bool_and("mask") if mode == "all" else F.bool_or("mask")
    got = named.groupBy(*key).agg(fold.alias("mask"), F.count("*").alias("n"))
    return got.select(*key, F.when(F.col("n") == len(masks), F.col("mask")).otherwise(F.raise_error(F.lit("masks cover different rows")).cast("boolean")).alias("mask"))


def masked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows whose mark is true; a row without a mark raises."""
    key = [*frame_key(rows, marks), "row_idx"]
    keep = F.coalesce("_mark", F.raise_error(F.lit("a row has no mark")).cast("boolean"))
    return rows.join(marks.select(*key, F.col("mask").alias("_mark")), key, "left").where(keep).select(*rows.columns)


def apply(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows that pass, numbered anew within their frames."""
    again = F.row_number().over(Window.partitionBy(*frame_key(rows)).orderBy("row_idx")) - 1
    return masked(rows, marks).withColumn("row_idx", again.cast("long"))


def by_coverage(points: DataFrame, reference: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Mask of points that have a reference point within ``tolerance`` in their frame.

    Both sides are cut into cells of that size; a point looks in the cells around it.
    """
    frame = frame_key(points, reference)
    key = [*frame, "row_idx"]
    size = max(tolerance, 1e-9)
    cell = [F.floor(F.col(k) / size).cast("long").alias(f"c{k}") for k in "xyz"]
    near = F.explode(F.flatten(F.flatten(F.array(*(F.array(*(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for c in (-1, 0, 1))) for b in (-1, 0, 1))) for a in (-1, 0, 1))))))
    ref = reference.select(*frame, *(F.col(k).alias(f"r{k}") for k in "xyz"), *cell)
    ref = ref.withColumn("o", near).select(*frame, "rx", "ry", "rz", (F.col("cx") + F.col("o.a")).alias("cx"), (F.col("cy") + F.col("o.b")).alias("cy"), (F.col("cz") + F.col("o.c")).alias("cz"))
    own = points.select(*key, "x", "y", "z", *cell)
    close = norm(F.col("x") - F.col("rx"), F.col("y") - F.col("ry"), F.col("z") - F.col("rz")) <= tolerance
    hit = own.join(ref, [*frame, "cx", "cy", "cz"]).where(close).select(*key).distinct().withColumn("hit", F.lit(True))
    return own.select(*key).join(hit, key, "left").select(*key, F.coalesce("hit", F.lit(False)).alias("mask"))


def selected(rows: DataFrame) -> DataFrame:
    """(frame, selected, total) of a mask."""
    return rows.groupBy(*frame_key(rows)).agg(F.count_if("mask").alias("selected"), F.count("*").alias("total"))
