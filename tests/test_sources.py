import json
import math

import pytest
from pyspark.sql import functions as F

from sightline.operators.prediction import path_displacement
from sightline.sources import bags, lanelets
from sightline.sources.scenes import SceneFolder


def test_path_displacement(spark):
    step = "array<struct<t:bigint,x:double,y:double>>"
    schema = f"e_x double, e_y double, e_class string, g_class string, e_modes array<struct<confidence:double,steps:{step}>>, g_future {step}, label_correct boolean"
    straight = [(100, 1.0, 0.0), (200, 2.0, 0.0)]
    rows = [
        (0.0, 0.0, "car", "car", [(0.4, [(100, 9.0, 0.0)]), (0.6, straight), (0.9, [])], [(50, 0.5, 0.0), (300, 3.0, 0.0)], True),
        (5.0, 0.0, "car", "car", [], [(100, 5.0, 2.0)], True),
        (0.0, 0.0, "bus", "car", [(1.0, straight)], straight, False),
        (0.0, 0.0, "bus", "bus", [(1.0, straight)], [], True),
    ]
    got = {(r["class"], r["k"]): r for r in path_displacement(spark.createDataFrame(rows, schema), (1, 2)).collect()}
    one = got["car", 1]  # gaps 0 and 1 of the likelier mode, held past its end; 2 standing still
    assert one["ade"] == pytest.approx((0.5 + 2) / 2) and one["fde"] == pytest.approx(1.5) and one["miss_rate"] == pytest.approx(1 / 3) and one["support"] == 3
    two = got["car", 2]  # the other mode is off by 4 and 6
    assert two["ade"] == pytest.approx(((0.5 + 5) / 2 + 2) / 2) and two["miss_rate"] == pytest.approx(3 / 5)
    assert got["bus", 1]["ade"] is None and got["bus", 1]["support"] == 1 and got[None, 1]["support"] == 4
    best = {(r["class"], r["k"]): r for r in path_displacement(spark.createDataFrame(rows, schema), (2,), best_of_k=True).collect()}
    assert best["car", 2]["ade"] == pytest.approx(1.25)
    with pytest.raises(ValueError):
        path_displacement(spark.createDataFrame(rows, schema), (1, 1))


def test_scene_folder(spark, tmp_path):
    turn = [math.cos(math.pi / 4), 0, 0, math.sin(math.pi / 4)]
    tables = {
        "scene": [{"token": "s", "name": "one", "first_sample_token": "a"}],
        "sample": [{"token": "b", "timestamp": 1_500_000, "scene_token": "s", "next": "", "prev": "a"}, {"token": "a", "timestamp": 1_000_000, "scene_token": "s", "next": "b", "prev": ""}],
        "sample_data": [{"token": f"d{k}{c}", "sample_token": k, "ego_pose_token": f"e{k}", "calibrated_sensor_token": c, "timestamp": 1_000_000, "is_key_frame": True} for k in "ab" for c in ("lidar", "cam")],
        "ego_pose": [{"token": "ea", "timestamp": 0, "translation": [10, 0, 0], "rotation": turn}, {"token": "eb", "timestamp": 0, "translation": [10, 0, 0], "rotation": turn}],
        "calibrated_sensor": [{"token": c, "sensor_token": c, "translation": [1, 0, 2], "rotation": [1, 0, 0, 0]} for c in ("lidar", "cam")],
        "sensor": [{"token": "lidar", "channel": "TOP", "modality": "lidar"}, {"token": "cam", "channel": "FRONT", "modality": "camera"}],
        "category": [{"token": "c", "name": "car", "index": 1}, {"token": "p", "name": "person", "index": 0}],
        "instance": [{"token": "i", "category_token": "c"}],
        "visibility": [{"token": "v", "level": "most"}],
        "sample_annotation": [{"token": f"x{k}", "sample_token": k, "instance_token": "i", "attribute_tokens": [], "visibility_token": "v", "translation": [10, y, 0], "size": [2, 4, 1.5], "rotation": turn, "num_lidar_pts": 7, "next": "", "prev": ""} for k, y in (("a", 5), ("b", 6))],
        "object_ann": [{"token": "o", "sample_data_token": "dacam", "instance_token": "i", "category_token": "c", "bbox": [10, 20, 40, 60]}],
    }
    for name, rows in tables.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    folder = SceneFolder(spark, str(tmp_path))
    assert folder.labels().names == ("person", "car")
    got = folder.entities("one", future_s=2)
    assert sorted(got) == ["/ground_truth/FRONT/objects", "/ground_truth/objects", "/tf/base_link", "/tf/sensors"]
    first, second = got["/ground_truth/objects"].orderBy("frame").collect()
    assert (first["x"], first["y"], first["yaw"]) == pytest.approx((5, 0, 0), abs=1e-9)  # ahead of the turned car
    assert (first["vx"], first["vy"]) == pytest.approx((2, 0), abs=1e-9) and first["visibility"] == 2 and first["class"] == "car"
    assert [s["t"] for s in first["future"]] == [500_000_000] and first["future"][0]["x"] == pytest.approx(6) and second["future"] == []
    flat = got["/ground_truth/FRONT/objects"].first()
    assert (flat["rx"], flat["ry"], flat["rh"], flat["rw"]) == (10, 20, 40, 30)
    assert folder.boxes3d("map").where("frame = 1").first()["y"] == pytest.approx(6)
    assert got["/tf/sensors"].count() == 2 and got["/tf/base_link"].count() == 2
    with pytest.raises(KeyError):
        folder.entities("two")


def test_lanelets(spark, tmp_path):
    point = lambda i, x, y: f'<node id="{i}" lat="1" lon="2"><tag k="local_x" v="{x}"/><tag k="local_y" v="{y}"/></node>'
    way = lambda i, *n: f'<way id="{i}">' + "".join(f'<nd ref="{k}"/>' for k in n) + "</way>"
    lane = lambda i, a, b, kind: f'<relation id="{i}"><member type="way" role="left" ref="{a}"/><member type="way" role="right" ref="{b}"/><tag k="type" v="lanelet"/><tag k="subtype" v="{kind}"/></relation>'
    text = '<?xml version="1.0"?><osm>' + "".join([point(1, 0, 1), point(2, 9, 1), point(3, 0, 0), point(4, 9, 0), way(10, 1, 2), way(11, 3, 4), way(12, 4, 3), lane(20, 10, 11, "road"), lane(21, 10, 12, "crosswalk"), lane(22, 10, 10, "road")]) + "</osm>"
    path = tmp_path / "map.osm"
    path.write_text(text)
    lanes = lanelets.lanelets(spark, str(path))
    ring = [(0.0, 1.0), (9.0, 1.0), (9.0, 0.0), (0.0, 0.0)]
    assert lanelets.polygons(lanelets.region(lanes, ["road"])) == [ring] and lanelets.polygons(lanelets.region(lanes)) == [ring, ring]
    assert lanelets.subtypes(lanes) == ["crosswalk", "road"] and lanelets.region(lanes, ["moon"]).isEmpty()
    path.write_text(text.replace('k="local_x"', 'k="other"'))
    with pytest.raises(Exception, match="no local coordinates"):
        lanelets.lanelets(spark, str(path)).collect()


def test_bags(spark):
    head = {"stamp": {"sec": 2, "nanosec": 5}, "frame_id": "map"}
    q = {"x": 0, "y": 0, "z": math.sin(math.pi / 4), "w": math.cos(math.pi / 4)}
    at = lambda x: {"position": {"x": x, "y": 0, "z": 0}, "orientation": q}
    one = {
        "object_id": {"uuid": list(range(16))}, "existence_probability": 0.5, "classification": [{"label": 1, "probability": 0.8}, {"label": 7, "probability": 0.8}],
        "shape": {"type": 0, "dimensions": {"x": 4, "y": 2, "z": 1}},
        "kinematics": {"pose": at(1), "twist": {"x": 3, "y": 0, "z": 0}, "has_twist": True, "paths": [{"confidence": 1, "time_step_ns": 500, "path": [at(1), at(2), at(3)]}]},
    }
    two = one | {"object_id": None, "classification": [], "shape": {"type": 1, "dimensions": {"x": 4, "y": 2, "z": 1}}, "kinematics": {"pose": at(1), "has_twist": False}}
    rows = [("/o", "predicted", 2_000_000_005, json.dumps({"header": head, "objects": [one, two]})), ("/o", "predicted", 9, json.dumps({"header": head, "objects": []}))]
    messages = spark.createDataFrame(rows, "topic string, kind string, stamp_ns long, message string")
    assert bags.topic(messages, "/o", 10, 2_000_000_005).count() == 0 and bags.topic(messages, "/o").count() == 2
    a, b = bags.objects(messages, "product").orderBy("row_idx").collect()
    assert (a["t"], a["class"], a["confidence"], a["w"], a["l"]) == (2_000_000_005, "car", pytest.approx(0.4), 2, 4)
    assert a["instance"] == "00010203-0405-0607-0809-0a0b0c0d0e0f" and (a["vx"], a["vy"]) == pytest.approx((0, 3), abs=1e-9)
    assert [(s["t"], s["x"]) for s in a["modes"][0]["steps"]] == [(500, 2.0), (1000, 3.0)]
    assert (b["class"], b["confidence"], b["w"], b["l"], b["vx"], b["modes"], b["instance"]) == ("unknown", 0.5, 4, 4, None, [], None)
    tf = lambda t, parent: ("/tf", "tf", t, json.dumps({"transforms": [{"header": {"stamp": {"sec": 0, "nanosec": t}, "frame_id": parent}, "child_frame_id": "base", "transform": {"translation": {"x": t, "y": 0, "z": 0}, "rotation": q}}]}))
    frame = lambda *rows: spark.createDataFrame(list(rows), messages.schema)
    edges = bags.transforms(frame(*(tf(t, "map") for t in (1, 1, 3, 5, 7, 9))))
    assert sorted(r["t"] for r in bags.windowed(edges, 4, 6).collect()) == [3, 5, 7] and edges.where(F.col("t") == 1).count() == 1
    with pytest.raises(Exception, match="two parents"):
        bags.transforms(frame(tf(1, "map"), tf(2, "odom"))).collect()
