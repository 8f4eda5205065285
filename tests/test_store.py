import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions.labels import LabelRegistry
from sightline.operators.matching import Matcher
from sightline.plans import store as S
from sightline.sources import bags, lanelets, mcap
from sightline.sources.recording import read_recording, write_recording
from sightline.streaming.counts import evaluate_stream


def points(spark, xs):
    return S.from_columns(spark, {"x": xs, "y": [0.0] * len(xs), "z": [0.0] * len(xs)}, "points")


def test_log_and_read(spark):
    store = S.Store(spark)
    store.log("/a", points(spark, [1.0, 2.0]), 5, "map")
    store.log("/a", points(spark, []), 7, "map")
    store.log("/a", points(spark, [3.0]), 5, "map")
    xs = lambda rows: [r.x for r in rows.orderBy("frame", "row_idx").collect()]
    assert xs(store.range("/a")) == [1.0, 2.0, 3.0] and [r.frame for r in store.times("/a").collect()] == [5, 7]
    assert xs(store.latest_at("/a", 6)) == [3.0] and xs(store.latest_at("/a", 9)) == []  # an empty frame is a frame
    assert sorted(map(tuple, store.partitions("/a").collect())) == [(5, 0, 2), (5, 2, 1), (7, 1, 0)]
    assert store.range("/a", 5, 5, ["x"]).columns[-1] == "x" and store.range("/a", 6, 9).count() == 0
    store.log_static("/a", spark.range(1).select(F.lit(9.0).alias("x"), F.lit("s").alias("sensor")))
    assert {(r.x, r.sensor) for r in store.range("/a").collect()} == {(9.0, "s")}
    with pytest.raises(KeyError):
        store.range("/b")
    store.log("/a", points(spark, [1.0]), 8, "base")
    with pytest.raises(ValueError, match="coordinate frames"):
        store.range("/a")


def test_archetypes(spark):
    with pytest.raises(ValueError, match="missing"):
        S.from_columns(spark, {"x": [1.0]}, "points")
    with pytest.raises(ValueError, match="lengths"):
        S.from_columns(spark, {"x": [1.0], "y": []})
    for name, value in (("confidence", 1.5), ("x", float("nan")), ("x", None), ("visibility", 9)):
        with pytest.raises(Exception, match="bad value"):
            S.from_columns(spark, {name: [value]}).collect()
    with pytest.raises(KeyError):
        S.component_type("smell")
    rows = points(spark, [1.0, 2.0]).withColumn("frame", F.lit(0).cast("long"))
    for bad in (rows.withColumnRenamed("x", "u"), rows.withColumn("x", F.col("x").cast("float"))):
        with pytest.raises(ValueError, match="different columns"):
            S.concat([rows, bad])


def test_selections(spark):
    rows = points(spark, [0.0, 10.0, 20.0, 30.0])
    xs = lambda sel: [r.x for r in S.select_rows(rows, sel).orderBy("row_idx").collect()]
    assert xs(slice(1, None, 2)) == [10.0, 30.0] and xs([-1, 0, 0]) == [30.0, 0.0, 0.0] and xs([True, False, False, True]) == [0.0, 30.0] and xs([]) == []
    for bad, kind in (([4], IndexError), ([True], ValueError), ([1.5], TypeError)):
        with pytest.raises(kind):
            S.positions(bad, 4)
    many = spark.range(10).select(F.col("id").alias("frame"))
    of = lambda sel: sorted(r.frame for r in S.narrow(many, sel).collect())
    assert of(slice(2, 8, 3)) == [2, 5] and of([-1, 0]) == [0, 9] and of(slice(-2, None)) == [8, 9]
    assert spark.range(1).select(S.same_values(F.lit(float("nan")), F.lit(float("nan")))).first()[0]


def test_arrow_and_recordings(spark, tmp_path):
    rows = points(spark, [1.0, 2.0]).withColumn("frame", F.lit(3).cast("long"))
    table = S.to_arrow(rows, "a/b", LabelRegistry(("car",)))
    path, back, labels = S.from_arrow(spark, table)
    assert path == "/a/b" and labels.names == ("car",) and table.schema.field("position").type.list_size == 3
    assert sorted(map(tuple, back.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(ValueError, match="version"):
        S.from_arrow(spark, table.replace_schema_metadata({}))
    at = f"file://{tmp_path}/rec"
    write_recording({"/a": rows}, at, LabelRegistry(("car",)), {"run": 1})
    with pytest.raises(FileExistsError):
        write_recording({"/a": rows}, at)
    entities, labels, about = read_recording(spark, at)
    assert entities["/a"].count() == 2 and labels.names == ("car",) and about == {"run": 1}
    rec = S.Recording(S.Store(spark), labels).with_metadata(k=1)
    assert rec.metadata == {"k": 1} and rec.agrees_with(S.Recording(S.Store(spark), LabelRegistry(("car",)))) and not rec.agrees_with(S.Recording(S.Store(spark)))
    manifest = json.loads((tmp_path / "rec/manifest.json").read_text())
    manifest["entities"]["/a"]["schema"]["fields"][0]["name"] = "other"
    (tmp_path / "rec/manifest.json").write_text(json.dumps(manifest))
    (tmp_path / "rec/.manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="other columns"):
        read_recording(spark, at)


def test_rings_that_cross_themselves(spark):
    bow = [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (-9.0, 2.0)]
    best = max(lanelets.loops(bow), key=lanelets.area)
    assert lanelets.area(best) == pytest.approx(max(lanelets.area(r) for r in lanelets.loops(bow))) and (2.0, 2.0) in best
    assert sum(map(lanelets.area, lanelets.loops([(0.0, 0.0), (2.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 2.0), (1.0, 1.0)]))) == pytest.approx(2.0)
    rings = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in bow]), (2, [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 2.0, "y": 2.0}])], "lanelet_id int, ring array<struct<x:double,y:double>>")
    got = lanelets.repaired(rings).collect()
    assert [r.lanelet_id for r in got] == [1] and len(got[0].ring) == len(best)


class Writer:
    """CDR, by the rules of the format."""

    def __init__(self):
        self.out = b""

    def put(self, letter, value):
        size = struct.calcsize(letter)
        self.out += b"\0" * (-len(self.out) % size) + struct.pack("<" + letter, value)
        return self

    def text(self, s):
        self.put("I", len(s) + 1)
        self.out += s.encode() + b"\0"
        return self

    def done(self):
        return b"\0\1\0\0" + self.out


DETECTED = """std_msgs/Header header
autoware/DetectedObject[] objects
================
MSG: std_msgs/Header
builtin_interfaces/Time stamp
string frame_id
================
MSG: autoware/DetectedObject
uint8 KIND=3
float32 existence_probability
autoware/Classification[] classification
autoware/Kinematics kinematics
autoware/Shape shape
================
MSG: autoware/Classification
uint8 label
float32 probability
================
MSG: autoware/Kinematics
geometry_msgs/PoseWithCovariance pose_with_covariance
bool has_twist
geometry_msgs/TwistWithCovariance twist_with_covariance
================
MSG: geometry_msgs/PoseWithCovariance
geometry_msgs/Pose pose
float64[2] covariance
================
MSG: geometry_msgs/Pose
geometry_msgs/Point position
geometry_msgs/Quaternion orientation
================
MSG: geometry_msgs/Point
float64 x
float64 y
float64 z
================
MSG: geometry_msgs/Quaternion
float64 x
float64 y
float64 z
float64 w
================
MSG: geometry_msgs/TwistWithCovariance
geometry_msgs/Twist twist
================
MSG: geometry_msgs/Twist
geometry_msgs/Point linear
================
MSG: autoware/Shape
uint8 type
geometry_msgs/Point dimensions
"""


def detected(stamp, x):
    w = Writer().put("i", stamp).put("I", 5).text("base_link").put("I", 1).put("f", 0.75).put("I", 1).put("B", 1).put("f", 0.5)
    for v in (x, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0):
        w.put("d", v)
    w.put("?", True)
    for v in (4.0, 0.0, 0.0):
        w.put("d", v)
    w.put("B", 0)
    for v in (5.0, 2.0, 1.5):
        w.put("d", v)
    return w.done()


def container(rows, compression):
    import zstandard

    text = lambda s: struct.pack("<I", len(s)) + s.encode()
    rec = lambda op, body: struct.pack("<BQ", op, len(body)) + body
    inner = rec(3, struct.pack("<H", 1) + text("autoware/msg/DetectedObjects") + text("ros2msg") + text(DETECTED)) + rec(4, struct.pack("<HH", 7, 1) + text("/objects") + text("cdr") + struct.pack("<I", 0))
    inner += b"".join(rec(5, struct.pack("<HIQQ", 7, i, t, t) + data) for i, (t, data) in enumerate(rows))
    packed = zstandard.compress(inner) if compression == "zstd" else inner
    chunk = struct.pack("<QQQI", 0, 0, len(inner), 0) + text(compression) + struct.pack("<Q", len(packed)) + packed
    return mcap.MAGIC + rec(1, text("ros2") + text("x")) + rec(6, chunk) + rec(15, b"\0" * 4) + rec(2, b"\0" * 20) + mcap.MAGIC


@pytest.mark.parametrize("compression", ["", "zstd"])
def test_containers(spark, tmp_path, compression):
    (tmp_path / "a.mcap").write_bytes(container([(10, detected(1, 1.0)), (20, detected(2, 2.0))], compression))
    (tmp_path / "b.mcap").write_bytes(container([(30, detected(3, 3.0))], compression))
    rows = mcap.read_bags(spark, str(tmp_path))
    assert sorted(map(tuple, mcap.topics_of(spark, str(tmp_path)).collect())) == [("/objects", "detected", 3)]
    assert [r.stamp_ns for r in mcap.read_bags(spark, str(tmp_path), start_ns=20, end_ns=30).collect()] == [20]
    got = sorted(bags.objects(rows).collect())
    assert [(r.t, r.x, r.w, r.l, r.vx, r["class"]) for r in got] == [(k * 10**9 + 5, float(k), 2.0, 5.0, 4.0, "car") for k in (1, 2, 3)]
    with pytest.raises(ValueError):
        list(mcap.messages(b"nothing"))


def test_stream_evaluates_whole_frames(spark, tmp_path):
    rows = []
    for f in range(6):
        for i in range(3):
            rows += [(f"2020-01-01 00:{10 * f // 60:02d}:{10 * f % 60:02d}", f, i, "car", 0.9, float(i * 10), 0.0, 0.0, gt) for gt in (True, False)]
    schema = "ts string, frame long, row_idx long, class string, confidence double, x double, y double, z double, is_gt boolean"
    rng = np.random.default_rng(0)
    order = np.argsort([int(r[1]) * 6 + rng.integers(0, 9) for r in rows], kind="stable")  # frames are split over files
    for k in range(4):
        part = [rows[i] for i in order[k::4]]
        spark.createDataFrame(part, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")

    def run(late):
        seen = []
        query = evaluate_stream(stream, Matcher("center_distance", 1.0), lambda batch, n: seen.extend((r.frame, r.status) for r in batch.collect()), f"{tmp_path}/{late}", late=late)
        query.processAllAvailable()
        query.stop()
        return sorted(seen)

    assert run("1 hour") == []  # nothing is complete within the lateness
    assert run("0 seconds") == [(f, 0) for f in range(6) for _ in range(3)]
