"""Inputs for which a wrong result would look plausible."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from sightline.functions import geometry as G
from sightline.functions import pose as P
from sightline.operators import filters as L
from sightline.operators import metrics as M
from sightline.operators import timeline as T
from sightline.operators.matching import Matcher, evaluate, match, match_join
from sightline.plans.pipeline import Catalog, Pipeline, average_precision_sweep, matching_step

BOX = "frame long, row_idx long, class string, instance string, confidence double, x double, y double, z double, yaw double, w double, l double, h double"


def boxes(spark, rows, schema=BOX):
    return spark.createDataFrame(rows, schema)


def box(frame, row, x, label="car", confidence=0.9, instance="a", y=0.0, yaw=0.0):
    return (frame, row, label, instance, confidence, x, y, 0.0, yaw, 1.0, 1.0, 1.0)


def values(rows):
    return {r["class"]: r["value"] for r in rows.collect()}


def scene(spark, gt, est, threshold=1.0, assignment="greedy"):
    e = boxes(spark, [box(0, i, x, confidence=c) for i, (x, c) in enumerate(est)])
    g = boxes(spark, [box(0, i, x) for i, x in enumerate(gt)])
    return evaluate(e, g, Matcher("center_distance", threshold, assignment=assignment))


@pytest.mark.parametrize(
    "gt,est,assignment,want",
    [
        ((0.0, 10.0), ((0.1, 0.95), (10.1, 0.85)), "greedy", 1.0),
        ((0.0, 10.0), ((0.1, 0.95), (500.0, 0.85)), "greedy", 0.438272),
        ((0.0, 10.0), ((0.1, 0.85), (500.0, 0.95)), "greedy", 0.197531),
        ((0.0,), ((0.8, 0.9), (0.1, 0.3)), "greedy", 0.993827),
        ((0.0,), ((0.8, 0.9), (0.1, 0.3)), "optimal", 0.444444),
        ((0.0,), ((0.1, 0.9), (0.8, 0.9)), "greedy", 0.993827),
        ((0.0,), (), "greedy", 0.0),
        ((), ((0.0, 0.5),), "greedy", 0.0),
    ],
)
def test_average_precision_of_known_scenes(spark, gt, est, assignment, want):
    got = values(M.average_precision(scene(spark, gt, est, assignment=assignment)))
    assert got["car"] == pytest.approx(want, abs=1e-5)


def plain_ap(hits, n, points=101, low=0.1, floor=0.1):
    """AP of hits in rank order by the definition."""
    tp = list(itertools.accumulate(hits))
    fp = list(itertools.accumulate(h <= 0 for h in hits))
    r, p = [t / n for t in tp], [t / max(t + f, 1e-12) for t, f in zip(tp, fp)]
    p = [max(p[i:]) for i in range(len(p))]

    def at(x):
        if x < r[0]:
            return p[0]
        if x > r[-1] + 1e-12:
            return 0.0
        j = max(i for i in range(len(r)) if r[i] <= x + 1e-12)
        return p[j] if j == len(r) - 1 else p[j] + (p[j + 1] - p[j]) * max(0.0, x - r[j]) / (r[j + 1] - r[j])

    first = round((points - 1) * low) + 1
    got = [max(at(i / (points - 1)) - floor, 0) for i in range(first, points)]
    return sum(got) / len(got) / (1 - floor)


@pytest.mark.parametrize("seed", range(4))
def test_average_precision_by_definition(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([3, 7, 40, 100])
    rows = [(i, rng.random() < 0.6, round(rng.random(), rng.choice([1, 3])) if rng.random() < 0.95 else None) for i in range(rng.choice([5, 60, 150]))]
    schema = "frame long, est_index long, label_correct boolean, e_class string, g_class string, e_confidence double"
    hits, used = [], 0
    for i, hit, c in rows:
        hit = hit and used < n
        used += hit
        hits.append((i // 7, i, hit, "car", "car" if hit else None, c))
    missed = [(900, -1, False, None, "car", None)] * (n - used)
    got = values(M.average_precision(spark.createDataFrame(hits + missed, schema)))["car"]
    order = sorted(hits, key=lambda r: (r[5] is not None, r[5] or 0, r[0], r[1]), reverse=True)
    assert got == pytest.approx(plain_ap([float(r[2]) for r in order], n), abs=1e-9)


def test_two_recordings_are_the_union_of_their_results(spark):
    rng = random.Random(2)
    side = lambda: [[box(f, i, rng.uniform(0, 8), rng.choice(["car", "bus"]), rng.random(), rng.choice("ab")) for f in range(4) for i in range(rng.randrange(1, 5))] for _ in range(2)]
    est, gt = side(), side()
    both = lambda sides: boxes(spark, [(*r, k) for k, rows in zip("pq", sides) for r in rows], BOX + ", recording string")
    for assignment in ("greedy", "optimal"):
        m = Matcher("center_distance", 2.0, assignment=assignment)
        got = sorted(map(tuple, match(both(est), both(gt), m).collect()))
        want = sorted((k, *r) for k, e, g in zip("pq", est, gt) for r in match(boxes(spark, e), boxes(spark, g), m).collect())
        assert got == want
    joined = evaluate(both(est), both(gt), Matcher("center_distance", 2.0, assignment="greedy"))
    # Identities are followed within a recording, and a frame of two recordings is two frames.
    alone = [M.id_switches(evaluate(boxes(spark, e), boxes(spark, g), Matcher("center_distance", 2.0, assignment="greedy"))) for e, g in zip(est, gt)]
    total = {}
    for rows in alone:
        for r in rows.collect():
            total[r["class"]] = total.get(r["class"], 0) + r.switches
    assert {r["class"]: r.switches for r in M.id_switches(joined).collect()} == total
    with pytest.raises(ValueError, match="recording"):
        match(both(est), boxes(spark, gt[0]))


def test_a_turn_turns_boxes_directions_and_paths(spark):
    step = "struct<t:bigint,x:double,y:double>"
    schema = f"x double, y double, z double, yaw double, vx double, vy double, vz double, qx double, qy double, qz double, qw double, future array<{step}>, modes array<struct<confidence:double,steps:array<{step}>>>, mask boolean"
    rows = spark.createDataFrame([(1.0, 0.0, 2.0, 0.2, 3.0, 0.0, 0.0, 0.0, 0.0, math.sin(0.1), math.cos(0.1), [(5, 2.0, 0.0)], [(0.5, [(5, 0.0, 2.0)])], True)], schema)
    quarter = P.pose(*(F.lit(v) for v in (10.0, 20.0, 0.0, 0.0, 0.0, math.sin(math.pi / 4), math.cos(math.pi / 4))))
    r = T.transform(rows.withColumn("pose", quarter)).first()
    assert (r.x, r.y, r.z) == pytest.approx((10, 21, 2)) and (r.vx, r.vy) == pytest.approx((0, 3)) and r.yaw == pytest.approx(0.2 + math.pi / 2)
    assert 2 * math.atan2(r.qz, r.qw) == pytest.approx(0.2 + math.pi / 2) and "mask" not in r.asDict()
    assert (r.future[0].t, r.future[0].x, r.future[0].y) == (5, pytest.approx(10), pytest.approx(22)) and (r.modes[0].steps[0].x, r.modes[0].steps[0].y) == (pytest.approx(8), pytest.approx(20))
    no_q = T.transform(rows.drop("qx", "qy", "qz", "qw").withColumn("pose", quarter)).first()
    assert no_q.yaw == pytest.approx(0.2 + math.pi / 2)
    back = T.transform(T.transform(rows.withColumn("pose", quarter)).withColumn("pose", quarter), invert=True).first()
    assert (back.x, back.y, back.yaw) == pytest.approx((1, 0, 0.2))


def test_classes_off_the_axis(spark):
    joined = scene(spark, (0.0,), ((0.1, 0.9),))
    with pytest.raises(Exception, match="off the axis"):
        M.confusion(joined, ["bus"]).collect()
    bad = joined.withColumn("status", F.lit(1))
    with pytest.raises(Exception, match="contradicts"):
        M.confusion(bad, ["car"]).collect()
    cells = spark.createDataFrame([(0, 0), (0, 7), (1, 1), (-1, 0), (2, 0)], "gt_class int, est_class int")
    got = {(r.gt_class, r.est_class): r["count"] for r in M.segmentation_confusion(cells, [0, 1, 2], [2]).collect()}
    assert got[0, -2] == 1 and sum(got.values()) == 3 and not any(2 in k for k in got)
    with pytest.raises(Exception, match="off the axis"):
        M.segmentation_confusion(cells, [0, 1]).collect()
    axis = {r["class"]: r for r in M.clear(joined, ["car", "zebra"]).collect()}
    assert axis["zebra"].mota is None and axis["zebra"].support == 0 and axis["car"].mota == 1.0
    assert values(M.average_precision(joined, ["car", "zebra"]))["zebra"] is None


def test_label_images(spark):
    rows = lambda image: M.pixels(spark.createDataFrame([(0, image)], "frame long, image array<array<int>>"))
    gt, est = [[0, 0, 1], [1, 1, 2]], [[0, 1, 1], [1, 0, 0]]
    got = {r["class"]: r for r in M.segmentation(M.elements(rows(est), rows(gt)), ignore=[2], classes=[0, 1, 2]).collect()}
    assert got[0].iou == pytest.approx(1 / 3) and got[1].iou == pytest.approx(2 / 4) and set(got) == {0, 1, None}
    for other in ([[0, 1], [1, 0], [0, 0]], [[0, 1, 1]]):
        with pytest.raises(Exception, match="different"):
            M.segmentation(M.elements(rows(other), rows(gt))).collect()
    with pytest.raises(Exception, match="one length"):
        rows([[0], [1, 2]]).collect()


def test_edges_of_lanes_and_empty_regions(spark):
    points = [(5.0, 0.5), (5.0, 0.0), (0.0, 0.5), (10.0, 0.5), (10.0, 1.0), (2.0, 0.5), (11.0, 0.5)]
    rows = boxes(spark, [box(0, i, x, y=y) for i, (x, y) in enumerate(points)])
    squares = [[(0.0, 0.0), (5.0, 0.0), (5.0, 1.0), (0.0, 1.0)], [(5.0, 0.0), (10.0, 0.0), (10.0, 1.0), (5.0, 1.0)]]
    inside = lambda marks: {points[r.row_idx] for r in marks.where("mask").collect()}
    assert inside(L.mask(rows, L.by_map(squares))) == {(5.0, 0.5), (2.0, 0.5)}
    lanes = spark.createDataFrame([([{"x": x, "y": y} for x, y in q],) for q in squares], "ring array<struct<x:double,y:double>>")
    for cell in (50.0, 3.0):
        assert inside(L.in_map(rows, lanes, cell)) == {(5.0, 0.5), (2.0, 0.5)}
    assert inside(L.mask(rows, L.by_map([]))) == set() == inside(L.in_map(rows, lanes.limit(0))) and len(inside(L.mask(rows, L.by_map(None)))) == 7
    with pytest.raises(Exception, match="no mark"):
        L.masked(rows, L.mask(rows, F.lit(True)).where("row_idx > 0")).collect()


def test_unknown_confidence_comes_last(spark):
    est = boxes(spark, [box(0, 0, 0.1, confidence=None), box(0, 1, 0.2, confidence=0.5)])
    got = match(est, boxes(spark, [box(0, 0, 0.0)]), Matcher("center_distance", 1.0, assignment="greedy"))
    assert got.where("status = 0").first().est_index == 1


def test_matcher_contract(spark):
    assert Matcher().assignment == "optimal"
    a, b = boxes(spark, [box(0, 0, 0.0)]), boxes(spark, [box(0, 0, 0.0)])
    with pytest.raises(Exception, match="coordinate frames"):
        match(a.withColumn("frame_id", F.lit("map")), b.withColumn("frame_id", F.lit("base"))).collect()
    assert match(a.withColumn("frame_id", F.lit("map")), b.withColumn("frame_id", F.lit(None).cast("string"))).count() == 1
    with pytest.raises(ValueError):
        Matcher(lambda e, g: F.lit(0.0))
    with pytest.raises(ValueError, match="missing"):
        match(a.drop("class"), b)
    side = lambda e, g: F.abs(F.col(e + "x") - F.col(g + "x"))
    assert match(a, b, Matcher(side, 0.5, larger=False)).first().status == 0
    stored = match(a, b).withColumn("est_index", F.lit(7).cast("long"))
    with pytest.raises(Exception, match="no row"):
        match_join(stored, a, b).collect()


def test_slabs_lose_no_pair(spark):
    rng = random.Random(8)
    side = lambda n: boxes(spark, [box(0, i, rng.choice([-3.0, 0.0, 1.5, 3.0, 4.5, 7.5]) + rng.choice([0, 1e-12, -1e-12]), y=rng.uniform(-2, 2)) for i in range(n)])
    est, gt = side(60), side(60)
    from sightline.operators.matching import feasible, sides

    near = G.bev_distance("e_", "g_")
    want = {(r.e_row_idx, r.g_row_idx) for r in sides(est, gt).where(near <= 1.5).collect()}
    assert want and {(r.e, r.g) for r in feasible(est, gt, Matcher("bev_distance", 1.5)).collect()} == want


def test_sweep_is_a_matching_for_each_threshold(spark):
    rng = random.Random(5)
    side = lambda: boxes(spark, [box(f, i, rng.uniform(0, 9), rng.choice(["car", "bus"]), rng.random()) for f in range(5) for i in range(6)])
    est, gt = side(), side()
    got = Pipeline(average_precision_sweep("/e", "/g", thresholds=(0.5, 1.0, 2.0), heading=True)).run(Catalog({"/e": est, "/g": gt}))
    for i, t in enumerate((0.5, 1.0, 2.0)):
        one = evaluate(est, gt, Matcher("center_distance", t, assignment="greedy"))
        assert values(got.get(f"/metrics/ap/{i}")) == pytest.approx(values(M.average_precision(one)))
        assert values(got.get(f"/metrics/aph/{i}")) == pytest.approx(values(M.average_precision(one, heading=True)))
    steps = matching_step("/e", "/g", Matcher())
    with pytest.raises(ValueError, match="later step"):
        Pipeline(steps[::-1])
    with pytest.raises(KeyError, match="lacks"):
        Pipeline(steps).run(Catalog({"/e": est.drop("class"), "/g": gt}))


# ---------------------------------------------------------------- geometry


def clip_area(one, two):
    """Area of the intersection of convex counter-clockwise polygons."""
    for (ax, ay), (bx, by) in zip(two, two[1:] + two[:1]):
        out, side = [], lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        for p, q in zip(one, one[1:] + one[:1]):
            s, t = side(p), side(q)
            if s >= 0:
                out.append(p)
            if s * t < 0:
                out.append((p[0] + s / (s - t) * (q[0] - p[0]), p[1] + s / (s - t) * (q[1] - p[1])))
        one = out
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(one, one[1:] + one[:1]))) / 2


def rotated(q, v):
    x, y, z, w = q
    a = (2 * (y * v[2] - z * v[1]), 2 * (z * v[0] - x * v[2]), 2 * (x * v[1] - y * v[0]))
    return (v[0] + w * a[0] + y * a[2] - z * a[1], v[1] + w * a[1] + z * a[0] - x * a[2], v[2] + w * a[2] + x * a[1] - y * a[0])


def test_footprints_of_any_rotation(spark):
    rng, rows, want = random.Random(1), [], []
    for i in range(60):
        pair = []
        for _ in range(2):
            q = [rng.gauss(0, 1) for _ in range(4)]
            n = math.sqrt(sum(v * v for v in q))
            pair.append((rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(0, 1), *(v / n for v in q), rng.uniform(1, 3), rng.uniform(1, 4), rng.uniform(1, 2)))
        rows.append((i, *pair[0], *pair[1]))
        rings = []
        for x, y, _, a, b, c, d, w, length, _ in pair:
            ring = [rotated((a, b, c, d), (u * length / 2, v * w / 2, 0)) for u, v in ((1, 1), (-1, 1), (-1, -1), (1, -1))]
            ring = [(x + p[0], y + p[1]) for p in ring]
            if sum(p[0] * r[1] - r[0] * p[1] for p, r in zip(ring, ring[1:] + ring[:1])) < 0:
                ring.reverse()
            rings.append(ring)
        want.append(clip_area(*rings))
    names = [f"{s}_{c} double" for s in "eg" for c in ("x", "y", "z", "qx", "qy", "qz", "qw", "w", "l", "h")]
    got = spark.createDataFrame(rows, "i int, " + ", ".join(names)).select("i", G.bev_intersection("e_", "g_", True).alias("a")).orderBy("i").collect()
    assert [r.a for r in got] == pytest.approx(want, abs=1e-9) and sum(v > 0 for v in want) > 20


@pytest.mark.parametrize("shift,want", [((1.0, 0.0), 1.0), ((0.0, 1.0), 1.0)])
def test_plane_distance(spark, shift, want):
    a, b = box(0, 0, 10.0 + shift[0], y=shift[1]), box(0, 0, 10.0)
    got = evaluate(boxes(spark, [a]), boxes(spark, [b]), Matcher("plane_distance", 5.0))
    assert got.first().score == pytest.approx(want)


def test_frames_and_resolver(spark):
    half = lambda a: (0.0, 0.0, math.sin(a / 2), math.cos(a / 2))
    schema = "t long, parent string, child string, tx double, ty double, tz double, qx double, qy double, qz double, qw double"
    edges = spark.createDataFrame([(0, "map", "base", 0.0, 0.0, 0.0, *half(0)), (10, "map", "base", 10.0, 0.0, 0.0, *half(math.pi / 2)), (None, "base", "lidar", 1.0, 0.0, 0.0, *half(0))], schema)
    rows = boxes(spark, [box(t, 0, 1.0) for t in (0, 5, 10, 12)]).withColumn("frame_id", F.lit("lidar"))
    at = lambda policy: [(round(r.x, 6), round(r.y, 6), round(r.yaw, 6)) for r in T.in_frame(rows, "map", T.Resolver(edges, policy)).orderBy("frame").collect()]
    q = round(math.pi / 2, 6)
    assert at("latest") == [(2, 0, 0), (2, 0, 0), (10, 2, q), (10, 2, q)] and at("nearest") == [(2, 0, 0), (2, 0, 0), (10, 2, q), (10, 2, q)]
    assert at("interpolate")[1] == (round(5 + math.sqrt(2), 6), round(math.sqrt(2), 6), round(math.pi / 4, 6))
    with pytest.raises(Exception, match="no pose"):
        at("exact")
    again = T.in_frame(T.in_frame(rows, "map", T.Resolver(edges)), "lidar", T.Resolver(edges)).collect()
    assert all(r.x == pytest.approx(1.0) and r.y == pytest.approx(0) and r.frame_id == "lidar" for r in again)
    graph = T.FrameGraph.of(edges)
    assert graph.frames == {"map", "base", "lidar"} and len(graph.path("lidar", "map")) == 2
    with pytest.raises(KeyError):
        graph.path("lidar", "moon")
    with pytest.raises(ValueError, match="twice"):
        T.FrameGraph.of(edges.unionByName(edges.where("t = 0").withColumn("t", F.lit(None).cast("long"))))
    with pytest.raises(ValueError, match="no parent"):
        T.FrameGraph.of(edges.withColumn("parent", F.lit(None).cast("string")))
    with pytest.raises(ValueError, match="no coordinate frame"):
        T.in_frame(rows.drop("frame_id"), "map")
    assert T.in_frame(rows, "lidar").count() == 4


def test_pair_times(spark):
    side = lambda ts: spark.createDataFrame([(t,) for t in ts], "t long")
    pairs = lambda a, b, tol: sorted(map(tuple, T.pair_times(side(a), side(b), tol).collect()))
    assert pairs([0, 30], [-25, 20], 30) == [(0, -25), (30, 20)] and pairs([0, 30], [-25, 20], 22) == [(30, 20)]
    assert pairs([0, 10], [6, 30], 25) == [(10, 6)] and pairs([0], [75], 75) == [(0, 75)] and pairs([0], [76], 75) == []
    two = lambda ts: spark.createDataFrame(ts, "recording string, t long")
    assert sorted(map(tuple, T.pair_times(two([("a", 0), ("b", 0)]), two([("a", 1), ("b", 9)]), 5, by=["recording"]).collect())) == [("a", 0, 1)]
    with pytest.raises(Exception, match="two times"):
        T.frame_times(spark.createDataFrame([(0, 1), (0, 2)], "frame long, t long")).collect()
