"""Entities derived from general tables: boxes, tracks, image boxes, points, poses."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_TYPES_BY = "event_type"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """row_idx from 0 within each frame."""
    return rows.withColumn("row_idx", (F.row_number().over(Window.partitionBy("frame").orderBy(*order)) - 1).cast("long"))


def tracks(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """``events`` as tracked objects, an hour a frame: even ids are ground truth, odd ones estimates."""
    hour = F.expr("CAST(timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS timestamp_ntz)) AS bigint)")
    rows = table(spark, sf_dir, "events").where(F.pmod("event_id", F.lit(2)) == (0 if side == "gt" else 1))
    rows = rows.select(hour.alias("frame"), "event_id", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), F.lit(0.0).alias("z"), F.col("event_type").alias("class"), F.col("user_id").alias("instance"), (F.col("event_id") * 7919 % 1000 / 1000.0).alias("confidence"))
    return _numbered(rows, "event_id").drop("event_id")


def boxes(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """``lineitem`` as boxes, a ship date a frame: odd lines are ground truth, even ones estimates.

    The yaw is a decimal product like that of the SQL: a product of doubles is a bit off for 61 of the
    360 degrees, and between opposite headings that bit tells whether AP by heading counts a miss.
    """
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") % 2 == (1 if side == "gt" else 0))
    rows = rows.select(
        F.expr("CAST(datediff(CAST(l_shipdate AS date), DATE'1970-01-01') AS bigint)").alias("frame"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"),
        ((F.lit(Decimal("6.283185307179586")) * (F.col("l_partkey") % 360)).cast("double") / 360).alias("yaw"),
        (F.col("l_quantity") / 10 + 1).alias("w"), (F.col("l_quantity") / 5 + 2).alias("l"), F.lit(2.0).alias("h"),
        F.col("l_returnflag").alias("class"), F.col("l_suppkey").alias("instance"),
        F.least(F.lit(1.0), F.col("l_extendedprice") / 110000).alias("confidence"),
        (F.col("l_partkey") % 500).cast("int").alias("rx"), (F.col("l_suppkey") % 500).cast("int").alias("ry"),
        (F.col("l_quantity") + 20).cast("int").alias("rh"), (F.col("l_linenumber") * 5 + 20).cast("int").alias("rw"),
        F.col("l_quantity").cast("int").alias("num_points"), (F.col("l_linenumber") % 5 - 1).cast("int").alias("visibility"),
    )
    return _numbered(rows, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").drop("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as a labelled point cloud: ten frames by id."""
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 10).alias("frame"), F.col("vec_id").alias("point_id"), e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), F.col("label").alias("class"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` as element labels: (frame, elem_idx, gt_class, est_class)."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select((F.col("doc_id") % 7).alias("frame"), F.col("doc_id").alias("elem_idx"), (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("gt_class"), (F.col("n_chars") % 4).cast("int").alias("est_class"))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as poses of ``base`` in ``map``, the largest order of each day."""
    day = F.expr("CAST(datediff(CAST(o_orderdate AS date), DATE'1970-01-01') AS bigint)")
    best = table(spark, sf_dir, "orders").groupBy(day.alias("t")).agg(F.max(F.struct("o_totalprice", "o_orderkey", "o_custkey")).alias("m"))
    yaw = F.lit(2 * math.pi) * (F.col("m.o_custkey") % 360) / 360
    zero = F.lit(0.0)
    return best.select("t", F.lit("map").alias("parent"), F.lit("base").alias("child"), (F.col("m.o_totalprice") / 1000).alias("tx"), (F.col("m.o_orderkey") % 100).cast("double").alias("ty"), zero.alias("tz"), zero.alias("qx"), zero.alias("qy"), F.sin(yaw / 2).alias("qz"), F.cos(yaw / 2).alias("qw"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as joined predictions: four paths of five steps against the next row's first path.

    Steps of estimates are 100 apart, those of ground truth 150, so the last ones lie beyond the estimates.
    """
    rows = table(spark, sf_dir, "embeddings")
    e = lambda i: F.col("embedding")[i].cast("double")
    steps = lambda mode, apart: F.array(*(F.struct(F.lit(apart * (i + 1)).cast("long").alias("t"), e(mode * 15 + i * 3).alias("x"), e(mode * 15 + i * 3 + 1).alias("y")) for i in range(5)))
    modes = F.array(*(F.struct(e(60 + m).alias("confidence"), steps(m, 100).alias("steps")) for m in range(4)))
    est = rows.select("vec_id", e(0).alias("e_x"), e(1).alias("e_y"), F.col("label").alias("e_class"), modes.alias("e_modes"))
    gt = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("g_class"), steps(0, 150).alias("g_future"))
    return est.join(gt, "vec_id").withColumn("label_correct", F.col("e_class") == F.col("g_class"))
