import random

import numpy as np
import pytest

from sightline.operators import greedy
from sightline.operators.greedy import nearest


def plain(est, gt, limit, deep, gate):
    """Turn by turn over all pairs."""
    free, took = list(range(len(gt))), []
    for e in est:
        flat = lambda g: np.sqrt((e[0] - gt[g, 0]) ** 2 + (e[1] - gt[g, 1]) ** 2)
        space = lambda g: np.sqrt((e[0] - gt[g, 0]) ** 2 + (e[1] - gt[g, 1]) ** 2 + (e[2] - gt[g, 2]) ** 2)
        score = space if deep else flat
        near = [(score(g), g) for g in free if score(g) <= limit[g] and (gate is None or space(g) <= gate)]
        took.append(min(near)[1] if near else -1)
        if near:
            free.remove(took[-1])
    return took


@pytest.mark.parametrize("flat", [4, 512])
@pytest.mark.parametrize("deep,gate", [(False, None), (True, None), (False, 1.5)])
@pytest.mark.parametrize("even", [True, False])
def test_nearest_is_the_plain_assignment(monkeypatch, flat, deep, gate, even):
    monkeypatch.setattr(greedy, "FLAT", flat)
    monkeypatch.setattr(greedy, "BLOCK", 4)
    monkeypatch.setattr(greedy, "SEEN", 3)
    rng = np.random.default_rng(3)
    for n, m, grid in ((0, 5, 3), (5, 0, 3), (1, 1, 1), (60, 70, 4), (150, 90, 25), (90, 150, 400)):
        est, gt = (rng.integers(0, grid, (k, 3)) / (grid / 8) for k in (n, m))
        for rows in (est, gt):
            rows[rng.random(len(rows)) < 0.05, rng.integers(0, 3)] = rng.choice([np.nan, np.inf])
        limit = np.full(m, 2.0) if even else rng.choice([0.5, 2.0, 3.0], m)
        with np.errstate(invalid="ignore"):
            assert nearest(est, gt, limit, deep, gate)[0].tolist() == plain(est, gt, limit, deep, gate)


def test_a_crowded_frame_is_matched_without_its_pairs(spark):
    # 9 million pairs are feasible here; their array in one row was more than a task's memory at size.
    from sightline.operators.matching import Matcher, match

    rng = random.Random(2)
    side = lambda: spark.createDataFrame([(0, i, rng.uniform(0, 3), rng.uniform(0, 3), 0.0, "car", rng.random()) for i in range(3000)], "frame long, row_idx long, x double, y double, z double, class string, confidence double")
    est, gt = side(), side()
    m = Matcher("bev_distance", 20.0, assignment="greedy")
    plan = match(est, gt, m)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    got = match(est, gt, m).where("status = 0").collect()
    e, g = (np.array([(r.x, r.y, r.z) for r in t.orderBy("row_idx").collect()]) for t in (est, gt))
    sure = [r.confidence for r in est.orderBy("row_idx").collect()]
    turn = sorted(range(3000), key=lambda i: (-sure[i], -i))
    want = plain_fast(e[turn], g)
    assert {r.est_index: r.gt_index for r in got} == {turn[k]: t for k, t in enumerate(want)}


def plain_fast(est, gt):
    gone, out = np.zeros(len(gt)), []
    for e in est:
        out.append(int(np.argmin(np.hypot(e[0] - gt[:, 0], e[1] - gt[:, 1]) + gone)))
        gone[out[-1]] = np.inf
    return out
