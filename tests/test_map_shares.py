from pyspark.sql import functions as F

from sightline.operators import filters as L


def test_a_crowded_cell_is_shared(spark):
    # All rows lie in one cell: dealt by the cell alone, one task got them all.
    rows = spark.range(2000).select(F.lit(0).cast("long").alias("frame"), F.col("id").alias("row_idx"), (F.col("id") % 10 + 0.5).alias("x"), F.lit(1.5).alias("y"))
    lanes = spark.createDataFrame([([{"x": x, "y": y} for x, y in ((0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0))],)], "ring array<struct<x:double,y:double>>")
    marks = L.in_map(rows, lanes, 100.0)
    assert "share" in marks._jdf.queryExecution().executedPlan().toString()
    got = {r.row_idx: r.mask for r in marks.collect()}
    assert got == {i: i % 10 + 0.5 < 5 for i in range(2000)}
