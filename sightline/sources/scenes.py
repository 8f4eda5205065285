"""Scene folders: one JSON array for each table, linked by tokens.

Times are microseconds, quaternions come as w x y z, image boxes as two corners.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions import pose as P
from sightline.functions.labels import LabelRegistry, intern

VEC = "array<double>"
SCHEMAS = {
    "scene": "token string, name string, first_sample_token string",
    "sample": "token string, timestamp long, scene_token string, next string, prev string",
    "sample_data": "token string, sample_token string, ego_pose_token string, calibrated_sensor_token string, timestamp long, is_key_frame boolean",
    "sample_annotation": f"token string, sample_token string, instance_token string, attribute_tokens array<string>, visibility_token string, translation {VEC}, size {VEC}, rotation {VEC}, num_lidar_pts int, next string, prev string",
    "object_ann": "token string, sample_data_token string, instance_token string, category_token string, bbox array<double>",
    "ego_pose": f"token string, timestamp long, translation {VEC}, rotation {VEC}",
    "calibrated_sensor": f"token string, sensor_token string, translation {VEC}, rotation {VEC}",
    "sensor": "token string, channel string, modality string",
    "instance": "token string, category_token string",
    "category": "token string, name string, index int",
    "visibility": "token string, level string",
}
#: Visibility levels, least first; unknown ones are -1.
VISIBILITY = ("none", "partial", "most", "full")
#: Seconds between neighbours up to which a velocity is given; twice that across both sides.
NEIGHBOUR_S = 1.5


def pose_of(translation: Column, rotation: Column) -> Column:
    """A pose from a vector and a w x y z quaternion, normalised."""
    norm = F.sqrt(F.aggregate(rotation, F.lit(0.0), lambda a, q: a + q * q))
    return P.pose(*(translation[i] for i in range(3)), *(rotation[i] / norm for i in (1, 2, 3, 0)))


def yaw_of(q: Column) -> Column:
    return F.atan2(2 * (q.qw * q.qz + q.qx * q.qy), 1 - 2 * (q.qy * q.qy + q.qz * q.qz))


class SceneFolder:
    """Tables of ``path``; ``frame`` counts a scene's samples by time from 0."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).option("multiLine", True).option("mode", "FAILFAST").json(f"{self.path}/{name}.json")

    @cached_property
    def frames(self) -> DataFrame:
        """(scene_token, sample_token, timestamp, frame); samples whose ``next`` is not the next in time raise."""
        order = Window.partitionBy("scene_token").orderBy("timestamp", "token")
        rows = self.table("sample").withColumn("_next", F.lead("token").over(order)).withColumn("_at", F.row_number().over(order) - 1)
        chained = F.coalesce(F.nullif("next", F.lit("")), F.lit("")) == F.coalesce("_next", F.lit(""))
        at = F.when(chained, F.col("_at")).otherwise(F.raise_error(F.concat(F.lit("the chain of samples breaks at "), F.col("token"))).cast("int"))
        return rows.select("scene_token", F.col("token").alias("sample_token"), "timestamp", at.cast("long").alias("frame"))

    def labels(self) -> LabelRegistry:
        """Category names by index, those without one last in the order of the table."""
        rows = self.table("category").select("name", "index").collect()
        return LabelRegistry(tuple(r["name"] for _, r in sorted(enumerate(rows), key=lambda x: (x[1]["index"] is None, x[1]["index"] or 0, x[0]))))

    def key_frames(self) -> DataFrame:
        """(sample_token, sample_data_token, channel, modality, ego, sensor pose) of key frames."""
        sensors = self.table("calibrated_sensor").join(self.table("sensor").toDF("sensor_token", "channel", "modality"), "sensor_token")
        sensors = sensors.select(F.col("token").alias("calibrated_sensor_token"), "channel", "modality", pose_of(F.col("translation"), F.col("rotation")).alias("mount"))
        ego = self.table("ego_pose").select(F.col("token").alias("ego_pose_token"), pose_of(F.col("translation"), F.col("rotation")).alias("ego"))
        data = self.table("sample_data").where("is_key_frame").withColumnRenamed("token", "sample_data_token").withColumnRenamed("timestamp", "data_time")
        return data.join(sensors, "calibrated_sensor_token").join(ego, "ego_pose_token").select("sample_token", "sample_data_token", "data_time", "channel", "modality", "ego", "mount")

    def ego_poses(self) -> DataFrame:
        """``map`` to ``base_link`` at each frame: of its key frames the one nearest to the sample's time."""
        rows = self.key_frames().join(self.frames, "sample_token")
        best = rows.groupBy("scene_token", "frame").agg(F.min_by("ego", F.struct(F.abs(F.col("data_time") - F.col("timestamp")), "channel")).alias("ego"))
        return best.select("scene_token", F.col("frame").alias("t"), F.lit("map").alias("parent"), F.lit("base_link").alias("child"), "ego.*")

    def extrinsics(self) -> DataFrame:
        """``base_link`` to each channel; a channel with two different mounts raises."""
        rows = self.key_frames().join(self.frames, "sample_token").select("scene_token", "channel", "mount").distinct()
        spread = lambda c: F.max(f"mount.{c}") - F.min(f"mount.{c}") > 1e-9
        differ = spread(P.PARTS[0])
        for c in P.PARTS[1:]:
            differ = differ | spread(c)
        got = rows.groupBy("scene_token", "channel").agg(F.min("mount").alias("mount"), differ.alias("differ"))
        child = F.when(F.col("differ"), F.raise_error(F.concat(F.lit("two mounts of "), F.col("channel"))).cast("string")).otherwise(F.col("channel"))
        return got.select("scene_token", F.lit("base_link").alias("parent"), child.alias("child"), "mount.*")

    def boxes3d(self, coords: str = "base_link", future_s: float = 0.0) -> DataFrame:
        """Annotated boxes in ``map``, ``base_link`` or a sensor's frame, with velocity and, if asked for, ``future``.

        The velocity is null without neighbours in time.  ``future`` holds the instance's later
        positions up to ``future_s`` seconds on, as (t in nanoseconds, x, y).
        """
        mounts = None if coords in ("map", "base_link") else self.extrinsics().where(F.col("child") == coords)
        if mounts is not None and mounts.isEmpty():
            raise ValueError(f"no sensor {coords}")
        ann = self.table("sample_annotation").join(self.frames, "sample_token")
        at = F.struct("timestamp", *(F.col("translation")[i].alias(k) for i, k in enumerate("xyz")))
        track = Window.partitionBy("scene_token", "instance_token").orderBy("timestamp")
        ann = ann.withColumn("at", at).withColumn("was", F.lag("at").over(track)).withColumn("will", F.lead("at").over(track))
        first, last = F.coalesce("was", "at"), F.coalesce("will", "at")
        dt = (last["timestamp"] - first["timestamp"]) / 1e6
        known = (dt > 0) & (dt <= F.when(F.col("was").isNotNull() & F.col("will").isNotNull(), 2 * NEIGHBOUR_S).otherwise(NEIGHBOUR_S))
        ann = ann.withColumns({f"v{k}": F.when(known, (last[k] - first[k]) / dt) for k in "xyz"})
        if future_s > 0:
            ahead = track.rangeBetween(1, int(future_s * 1e6))
            ann = ann.withColumn("later", F.collect_list("at").over(ahead))
        else:
            ann = ann.withColumn("later", F.array().cast("array<struct<timestamp:bigint,x:double,y:double,z:double>>"))
        level = F.element_at(F.create_map(*(F.lit(x) for kv in ((v, i) for i, v in enumerate(VISIBILITY)) for x in kv)), F.col("level"))
        names = self.table("instance").toDF("instance_token", "category_token").join(self.table("category").select(F.col("token").alias("category_token"), F.col("name").alias("class")), "category_token").drop("category_token")
        ann = ann.join(names, "instance_token").join(self.table("visibility").toDF("visibility_token", "level"), "visibility_token", "left")
        ann = ann.withColumn("own", pose_of(F.col("translation"), F.col("rotation")))
        if coords != "map":
            ego = self.ego_poses().select("scene_token", F.col("t").alias("frame"), P.pose(*(F.col(c) for c in P.PARTS)).alias("ego"))
            ann = ann.join(ego, ["scene_token", "frame"]).withColumn("back", P.invert(F.col("ego")))
            if mounts is not None:
                mount = mounts.select("scene_token", P.pose(*(F.col(c) for c in P.PARTS)).alias("mount"))
                ann = ann.join(mount, "scene_token").withColumn("back", P.compose(P.invert(F.col("mount")), F.col("back")))
        else:
            ann = ann.withColumn("back", P.identity())
        own = ann.withColumn("own", P.compose(F.col("back"), F.col("own")))
        move = lambda s: P.apply_point(F.col("back"), s["x"], s["y"], s["z"])
        future = F.transform("later", lambda s: F.struct(((s["timestamp"] - F.col("timestamp")) * 1000).alias("t"), move(s)[0].alias("x"), move(s)[1].alias("y")))
        speed = P.rotate(F.col("back"), *(F.col(f"v{k}") for k in "xyz"))
        out = own.select(
            "scene_token", "frame", F.col("token").alias("annotation"), "class", F.col("instance_token").alias("instance"),
            *(F.col(f"own.t{k}").alias(k) for k in "xyz"), *(F.col(f"own.q{k}").alias(f"q{k}") for k in "xyzw"), yaw_of(F.col("own")).alias("yaw"),
            *(F.col("size")[i].alias(k) for i, k in enumerate("wlh")), *(v.alias(f"v{k}") for v, k in zip(speed, "xyz")),
            F.col("num_lidar_pts").alias("num_points"), F.coalesce(level, F.lit(-1)).alias("visibility"), future.alias("future"), F.lit(coords).alias("frame_id"),
        )
        return _numbered(out, ["scene_token", "frame"], "annotation")

    def boxes2d(self) -> DataFrame:
        """Image boxes (rx, ry, rh, rw) by channel, of key frames."""
        names = self.table("category").select(F.col("token").alias("category_token"), F.col("name").alias("class"))
        rows = self.table("object_ann").withColumnRenamed("sample_data_token", "on").join(self.key_frames().withColumnRenamed("sample_data_token", "on"), "on").join(self.frames, "sample_token").join(names, "category_token")
        b = lambda i: F.col("bbox")[i]
        size = {"rx": b(0), "ry": b(1), "rh": b(3) - b(1), "rw": b(2) - b(0)}
        rows = rows.select("scene_token", "channel", "frame", F.col("token").alias("annotation"), "class", F.col("instance_token").alias("instance"), *(F.round(c).cast("int").alias(k) for k, c in size.items()))
        return _numbered(rows, ["scene_token", "channel", "frame"], "annotation")

    def entities(self, scene: str, root: str = "/ground_truth", coords: str = "base_link", future_s: float = 0.0) -> dict[str, DataFrame]:
        """One scene (its token or name) as entities by path."""
        token = self.table("scene").where((F.col("token") == scene) | (F.col("name") == scene)).select("token").limit(2).collect()
        if len(token) != 1:
            raise KeyError(f"{len(token) and 'more than one' or 'no'} scene {scene!r}")
        of = lambda rows: rows.where(F.col("scene_token") == token[0][0]).drop("scene_token")
        flat = of(self.boxes2d())
        out = {f"{root}/objects": of(self.boxes3d(coords, future_s)), "/tf/base_link": of(self.ego_poses()), "/tf/sensors": of(self.extrinsics())}
        channels = [r[0] for r in self.table("sensor").where("modality = 'camera'").select("channel").distinct().collect()]
        return out | {f"{root}/{c}/objects": flat.where(F.col("channel") == c).drop("channel") for c in sorted(channels)}


    def import_scenes(self, scenes: list[str] | None = None, **options) -> dict[str, DataFrame]:
        """All or some scenes as entities by path, told apart by ``recording``, the scene's token."""
        names = scenes if scenes is not None else sorted(r[0] for r in self.table("scene").select("token").collect())
        out: dict[str, DataFrame] = {}
        for token in names:
            for path, rows in self.entities(token, **options).items():
                rows = rows.withColumn("recording", F.lit(token))
                out[path] = out[path].unionByName(rows) if path in out else rows
        return out

    def instances(self) -> DataFrame:
        """(instance, instance_id): numbers in the order in which instances are first annotated."""
        rows = self.table("sample_annotation").join(self.frames, "sample_token").select(F.col("instance_token").alias("instance"), "scene_token", "frame", "token")
        return intern(rows, "instance", ["scene_token", "frame", "token"])


def _numbered(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    return rows.withColumn("row_idx", (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("long"))
