import random

import pytest
from pyspark.sql import functions as F

from sightline.operators.matching import SCORES, Matcher, assign_greedy, feasible, match, scored, sides

NAMES = "frame long, row_idx long, class string, confidence double, x double, y double, z double, yaw double, w double, l double, h double, rx int, ry int, rw int, rh int"


def side(spark, seed, odd):
    rng = random.Random(seed)
    rows = []
    for f in range(3):
        for i in range(40):
            r = [f, i, rng.choice("ab"), rng.random(), rng.randrange(9) * 1.0, rng.randrange(9) * 1.0, rng.randrange(3) * 0.5, rng.randrange(8) * 0.785, 1.0 + rng.randrange(3), 2.0 + rng.randrange(4), 2.0, rng.randrange(30), rng.randrange(30), 20, 30]
            if odd and i % 5 == 0:
                r[rng.randrange(4, 15)] = None
            if odd and i % 7 == 0:
                r[rng.choice([4, 5, 6, 8, 9, 10])] = float("nan")
            rows.append(tuple(r))
    return spark.createDataFrame(rows, NAMES)


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("name", ["iou_roi", "iou_bev", "iou_3d", "plane_distance"])
def test_kernels_score_as_expressions(spark, name, odd):
    est, gt = side(spark, 1, odd), side(spark, 2, odd)
    score = SCORES[name][0]("e_", "g_")
    want = sides(est, gt).where("e_class = g_class").select("frame", F.col("e_row_idx").alias("e"), F.col("g_row_idx").alias("g"), score.alias("score"))
    plain = lambda rows: {(r.frame, r.e, r.g): None if r.score is None or r.score != r.score else round(r.score, 9) for r in rows.collect()}
    got = scored(est, gt, name)
    assert plain(got) == plain(want)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()  # pairs were joined and scored by interpreted lambdas


@pytest.mark.parametrize("name,limit", [("iou_roi", 0.3), ("iou_bev", 0.1), ("iou_3d", 0.1), ("plane_distance", 3.0)])
def test_matching_by_kernels_is_that_of_the_pairs(spark, name, limit):
    est, gt = side(spark, 3, True), side(spark, 4, True)
    for m in (Matcher(name, limit, assignment="greedy"), Matcher(name, limit, {"a": limit * 2}, class_agnostic=True, max_distance=2.5, assignment="greedy")):
        want = {(r.frame, r.e, r.g) for r in assign_greedy(feasible(est, gt, m), m.better).collect()}
        assert want and {(r.frame, r.est_index, r.gt_index) for r in match(est, gt, m).where("status = 0").collect()} == want


def test_area_of_a_footprint_on_another(spark):
    row = lambda **k: {"frame": 0, "row_idx": 0, "class": "a", "x": 0.0, "y": 0.0, "z": 0.0, "yaw": 0.0, "w": 2.0, "l": 4.0, "h": 2.0, **k}
    got = scored(spark.createDataFrame([row()]), spark.createDataFrame([row(x=2.0)]), "iou_bev").first().score
    assert got == pytest.approx(4 / 12)
    lost = scored(spark.createDataFrame([row()]), spark.createDataFrame([row(x=2.0, yaw=float("nan"))]), "iou_bev").first().score
    assert lost != lost  # the expression gave 8 / 8: the whole estimate
