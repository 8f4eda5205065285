"""Recorded messages, decoded to JSON by whatever reads the container: ``(topic, kind, stamp_ns, message)``.

``kind`` is detected, tracked or predicted (objects) or tf (transforms).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import pose as P
from sightline.sources.scenes import yaw_of

XYZ = "struct<x:double,y:double,z:double>"
QUAT = "struct<x:double,y:double,z:double,w:double>"
POSE = f"struct<position:{XYZ},orientation:{QUAT}>"
HEADER = "header struct<stamp:struct<sec:bigint,nanosec:bigint>,frame_id:string>"
OBJECTS = f"""{HEADER}, objects array<struct<
  object_id:struct<uuid:array<int>>, existence_probability:double, classification:array<struct<label:int,probability:double>>,
  shape:struct<type:int,dimensions:{XYZ}>,
  kinematics:struct<pose:{POSE},twist:{XYZ},has_twist:boolean,paths:array<struct<confidence:double,time_step_ns:bigint,path:array<{POSE}>>>>>>"""
TRANSFORMS = f"transforms array<struct<{HEADER.replace('header struct', 'header:struct')},child_frame_id:string,transform:struct<translation:{XYZ},rotation:{QUAT}>>>"
#: Classes by label number, and the shape number of a cylinder.
CLASSES = ("unknown", "car", "truck", "bus", "trailer", "motorcycle", "bicycle", "pedestrian", "animal", "hazard", "over_drivable", "under_drivable")
CYLINDER = 1


def topic(messages: DataFrame, name: str, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Messages of one topic from ``start_ns`` up to before ``end_ns``; both filters reach the scan."""
    rows = messages.where(F.col("topic") == name)
    if start_ns is not None:
        rows = rows.where(F.col("stamp_ns") >= start_ns)
    return rows if end_ns is None else rows.where(F.col("stamp_ns") < end_ns)


def _stamp(stamp: Column) -> Column:
    return stamp["sec"] * 1_000_000_000 + stamp["nanosec"]


def _pose(p: Column, q: Column) -> Column:
    norm = F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"] + q["w"] * q["w"])
    return P.pose(p["x"], p["y"], p["z"], *(q[k] / norm for k in "xyzw"))


def objects(messages: DataFrame, confidence: str = "classification") -> DataFrame:
    """One row an object: (t, row_idx, class, confidence, instance, pose, size, velocity, modes).

    Sizes come as length, width, height; a cylinder's diameter is its first.  ``confidence`` is the best
    class's probability, that of existence or the product; existence where no class is given.  A label
    number outside ``CLASSES`` raises.  A velocity in the body's axes is turned
    into those of the header; without one it is null.  Paths begin after the present pose.
    """
    if confidence not in ("classification", "existence", "product"):
        raise ValueError(confidence)
    parsed = messages.select(F.from_json("message", OBJECTS, {"mode": "FAILFAST"}).alias("m"))
    rows = parsed.select(_stamp(F.col("m.header.stamp")).alias("t"), F.col("m.header.frame_id").alias("frame_id"), F.posexplode("m.objects").alias("row_idx", "o"))
    best = F.try_element_at(F.array_sort(F.transform("o.classification", lambda c, i: F.struct((-c["probability"]).alias("p"), i.alias("i"), c["label"].alias("label")))), F.lit(1))
    rows = rows.withColumn("best", best).withColumn("at", _pose(F.col("o.kinematics.pose.position"), F.col("o.kinematics.pose.orientation")))
    there = F.col("o.existence_probability")
    sure = -F.col("best.p")
    value = {"classification": sure, "existence": there, "product": sure * there}[confidence]
    name = F.get(F.array(*map(F.lit, CLASSES)), F.col("best.label"))
    name = F.when(F.col("best").isNull(), CLASSES[0]).otherwise(F.coalesce(name, F.raise_error(F.concat(F.lit("unknown label "), F.col("best.label").cast("string"))).cast("string")))
    d, round_ = F.col("o.shape.dimensions"), F.col("o.shape.type") == CYLINDER
    twist = F.col("o.kinematics.twist")
    speed = P.rotate(F.col("at"), *(F.when(F.coalesce("o.kinematics.has_twist", F.lit(True)), twist[k]) for k in "xyz"))
    step = lambda p: F.transform(F.slice(p["path"], 2, F.greatest(F.size(p["path"]), F.lit(1))), lambda s, i: F.struct(((i + 1) * p["time_step_ns"]).cast("long").alias("t"), s["position"]["x"].alias("x"), s["position"]["y"].alias("y")))
    modes = F.transform(F.coalesce("o.kinematics.paths", F.array().cast(f"array<struct<confidence:double,time_step_ns:bigint,path:array<{POSE}>>>")), lambda p: F.struct(p["confidence"].alias("confidence"), step(p).alias("steps")))
    uuid = F.array_join(F.transform("o.object_id.uuid", lambda b: F.lpad(F.lower(F.hex(F.pmod(b, F.lit(256)))), 2, "0")), "")
    return rows.select(
        "t", F.col("row_idx").cast("long").alias("row_idx"), "frame_id",
        name.alias("class"), F.coalesce(value, there).alias("confidence"), F.when(F.length(uuid) == 32, F.regexp_replace(uuid, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).alias("instance"),
        *(F.col(f"at.t{k}").alias(k) for k in "xyz"), *(F.col(f"at.q{k}").alias(f"q{k}") for k in "xyzw"), yaw_of(F.col("at")).alias("yaw"),
        F.when(round_, d["x"]).otherwise(d["y"]).alias("w"), d["x"].alias("l"), d["z"].alias("h"),
        *(v.alias(f"v{k}") for v, k in zip(speed, "xyz")), modes.alias("modes"),
    )


def transforms(messages: DataFrame) -> DataFrame:
    """One row a transform: (t, parent, child, pose columns), repeats once; a child of two parents raises."""
    rows = messages.select(F.explode(F.from_json("message", TRANSFORMS, {"mode": "FAILFAST"})["transforms"]).alias("x"))
    rows = rows.select(_stamp(F.col("x.header.stamp")).alias("t"), F.col("x.header.frame_id").alias("parent"), F.col("x.child_frame_id").alias("child"), _pose(F.col("x.transform.translation"), F.col("x.transform.rotation")).alias("p")).select("t", "parent", "child", "p.*").distinct()
    parents = rows.groupBy("child").agg(F.min("parent").alias("low"), F.max("parent").alias("high"))
    own = F.when(F.col("low") != F.col("high"), F.raise_error(F.concat(F.lit("two parents of "), F.col("child"))).cast("string")).otherwise(F.col("parent"))
    return rows.join(parents, "child").select("t", own.alias("parent"), "child", *P.PARTS)


def windowed(edges: DataFrame, start: int, end: int) -> DataFrame:
    """Transforms of [start, end) and, for each child, the last one before and the first one after."""
    marks = edges.groupBy("child").agg(F.max(F.when(F.col("t") < start, F.col("t"))).alias("low"), F.min(F.when(F.col("t") >= end, F.col("t"))).alias("high"))
    keep = F.col("t").between(F.coalesce("low", F.lit(start)), F.coalesce("high", F.lit(end - 1)))
    return edges.join(marks, "child").where(keep).select(*edges.columns)
