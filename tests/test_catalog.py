import pytest

from sightline.functions.labels import LabelRegistry
from sightline.operators.metrics import of_class
from sightline.plans.assembly import Source, assemble, assemble_pair
from sightline.plans.pipeline import Catalog, Pipeline, Step


def test_static_columns(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    catalog = Catalog({"/a": frame([(1, 2), (2, 3)], "frame long, x long")})
    assert catalog.static("/a") is None and catalog.view("/a").count() == 2
    catalog.put_static("/base", frame([(7, "map")], "w long, frame_id string"))
    catalog.inherit_static("/a", "/base")
    catalog.put_static("/a", frame([(8,)], "w long"))
    catalog.put_static("/base", frame([("base_link",)], "frame_id string"))  # seen by heirs too
    got = catalog.view("/a").select("frame", "x", "w", "frame_id").orderBy("frame").collect()
    assert [tuple(r) for r in got] == [(1, 2, 8, "base_link"), (2, 3, 8, "base_link")]
    catalog.put_static("/a", frame([(0,)], "x long"))
    assert {r["x"] for r in catalog.view("/a").collect()} == {0}
    for path, source in (("/base", "/a"), ("/b", "/b")):
        with pytest.raises(ValueError):
            catalog.inherit_static(path, source)
    catalog.put_static("/a", frame([(1,), (2,)], "w long"))
    with pytest.raises(Exception, match="need one row"):
        catalog.view("/a").collect()


def test_pipeline_checks_its_inputs_first(spark):
    ran = []
    steps = [Step("/b", ("/a",), lambda a: ran.append(1) or a), Step("/c", ("/b", "/lost"), lambda b, x: b)]
    with pytest.raises(KeyError, match="lost"):
        Pipeline(steps).run(Catalog({"/a": spark.range(1)}))
    assert not ran


def test_assemble(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    first, second = LabelRegistry(("car", "bus")), LabelRegistry(("bus", "car", "bike"))
    a, b = Catalog({"/o": frame([(0, 0), (1, 1)], "frame long, class_id int")}), Catalog({"/o": frame([(7, 0), (8, 1), (9, 2), (9, -1)], "frame long, class_id int")})
    a.put_static("/o", frame([("map",)], "frame_id string"))
    gt, est = Source(a, {"/o": "/gt"}, first), Source(b, {"/o": "/est"}, second)
    with pytest.raises(KeyError, match="bike"):
        assemble([gt, est])
    got = assemble([gt, est], missing="unknown", tags={"run": "1"})
    assert sorted(map(tuple, got.catalog.get("/est").collect())) == [(7, 1), (8, 0), (9, -1), (9, -1)]
    assert got.labels == first and got.catalog.view("/gt").first()["frame_id"] == "map"
    times = frame([(0, 1000), (1, 2000)], "frame long, t long"), frame([(7, 2010), (8, 5000), (9, 990)], "frame long, t long")
    pair = lambda unmatched: assemble_pair(gt, est, times, 50, unmatched=unmatched, missing="unknown").catalog
    assert sorted(map(tuple, pair("keep").get("/est").select("frame", "class_id").collect())) == [(0, -1), (0, -1), (1, 1)]
    lone = (frame([(0, 1000), (1, 9000)], "frame long, t long"), times[1])
    assert [r["frame"] for r in assemble_pair(gt, est, lone, 50, unmatched="drop", missing="unknown").catalog.get("/gt").collect()] == [0]
    with pytest.raises(ValueError, match="two entities"):
        assemble([gt, Source(b, {"/o": "gt"})])
    b.put_static("/o", frame([("base_link",)], "frame_id string"))
    with pytest.raises(ValueError, match="different frames"):
        assemble([gt, est], missing="unknown")
    assemble([gt, est], missing="unknown", same_frame=False)
    ids = lambda name: frame([(name, 0)], "instance string, instance_id long")
    with pytest.raises(ValueError, match="instance id 0"):
        assemble([Source(a, {}, instances=ids("x")), Source(b, {}, instances=ids("y"))])


def test_of_class(spark):
    values = spark.createDataFrame([("car", 1.0), (None, 2.0), ("bus", 3.0), ("bus", 4.0)], "class string, value double")
    assert of_class(values, "car").first()["value"] == 1.0 and of_class(values, None).first()["value"] == 2.0
    for label in ("bus", "bike"):
        with pytest.raises(Exception, match="not one row"):
            of_class(values, label).collect()
