import os

import pytest
from pyspark.sql import functions as F

import sightline.queries as Q
from sightline.sources import tables as S

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", ["score_iou_bev", "score_iou_3d", "score_plane_distance"])
def test_scores_cover_all_frames(spark, name):
    est, gt = (S.boxes(spark, SF, k).groupBy("frame", "class").agg(F.count("*").alias(k)) for k in ("est", "gt"))
    want = {r.frame: r.n for r in est.join(gt, ["frame", "class"]).groupBy("frame").agg(F.sum(F.col("est") * F.col("gt")).alias("n")).collect()}
    got = {r.frame: r["count"] for r in Q.queries()[name](spark, SF).groupBy("frame").count().collect()}
    assert got == want and any(f % 20 for f in got)
