import itertools
import random

import pytest

from sightline.operators.matching import assign_optimal


def brute(pairs, sign):
    """(pairs, total) of the best assignment: most pairs, then least signed score."""
    best = (0, 0.0)
    for k in range(1, len(pairs) + 1):
        for some in itertools.combinations(pairs, k):
            if len({e for e, _, _ in some}) == len({g for _, g, _ in some}) == k:
                best = min(best, (-k, sum(sign * s for _, _, s in some)))
    return best


@pytest.mark.parametrize("larger", [False, True])
def test_optimal_assignment_of_contested_frames(spark, larger):
    rng = random.Random(4)
    frames = {f: [(e, g, rng.randrange(1, 9) / 8) for e in range(rng.randrange(1, 5)) for g in range(rng.randrange(1, 5)) if rng.random() < 0.8][:11] for f in range(40)}
    frames[40] = [(0, 0, 0.125), (0, 1, 0.25), (1, 0, 0.25)]  # greedy would take one pair
    rows = [(f, e, g, 0.5, s) for f, pairs in frames.items() for e, g, s in pairs]
    got = assign_optimal(spark.createDataFrame(rows, "frame long, e long, g long, confidence double, score double"), larger).collect()
    sign = -1 if larger else 1
    for f, pairs in frames.items():
        mine = [(r.e, r.g, r.score) for r in got if r.frame == f]
        assert all(m in pairs for m in mine) and len({m[0] for m in mine}) == len({m[1] for m in mine}) == len(mine)
        assert (-len(mine), sum(sign * m[2] for m in mine)) == brute(pairs, sign)
