"""Lanes of a road map in OSM XML, as polygons for the map filter."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAGS = "tag array<struct<_k:string,_v:string>>"


def loops(ring: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """The simple rings that a ring falls into where it crosses or touches itself."""
    ring = [p for i, p in enumerate(ring) if p != ring[i - 1]]
    n = len(ring)
    for i in range(n):
        for j in range(i + 1, n):
            a, b, c, d = ring[i], ring[(i + 1) % n], ring[j], ring[(j + 1) % n]
            if a == c:
                return loops(ring[i:j]) + loops(ring[j:] + ring[:i])
            if j == i + 1 or (j + 1) % n == i:
                continue
            r, s = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1])
            down = r[0] * s[1] - r[1] * s[0]
            if down == 0:
                continue
            t = ((c[0] - a[0]) * s[1] - (c[1] - a[1]) * s[0]) / down
            u = ((c[0] - a[0]) * r[1] - (c[1] - a[1]) * r[0]) / down
            if 0 < t < 1 and 0 < u < 1:
                x = (a[0] + t * r[0], a[1] + t * r[1])
                return loops([x, *ring[i + 1 : j + 1]]) + loops([x, *ring[j + 1 :], *ring[: i + 1]])
    return [ring] if n >= 3 else []


def area(ring: list[tuple[float, float]]) -> float:
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))) / 2


def repaired(rings: DataFrame) -> DataFrame:
    """``rings(.., ring)`` with each ring that crosses itself replaced by its largest loop; rings without area go."""
    names = rings.columns
    k = names.index("ring")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, keep = [], []
            for i, ring in enumerate(batch.column(k).to_pylist()):
                best = max(loops([(p["x"], p["y"]) for p in ring]), key=area, default=[])
                if best and area(best) > 0:
                    keep.append(i)
                    new.append([{"x": x, "y": y} for x, y in best])
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(new, batch.column(k).type) if c == "ring" else some.column(i) for i, c in enumerate(names)], names)

    return rings.mapInArrow(run, rings.schema)


def _read(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def _tag(name: str):
    return F.try_element_at(F.transform(F.filter("tag", lambda t: t["_k"] == name), lambda t: t["_v"]), F.lit(1))


def lanelets(spark: SparkSession, path: str) -> DataFrame:
    """(lanelet_id, subtype, ring): the left bound, then the right one backwards.

    Nodes without local coordinates raise.  Of a ring that crosses itself the largest loop stays;
    rings without area are left out.
    """
    nodes = _read(spark, path, "node", f"_id long, {TAGS}")
    local = {k: _tag(f"local_{k}").cast("double") for k in "xy"}
    known = lambda k: F.coalesce(local[k], F.raise_error(F.concat(F.lit("no local coordinates at node "), F.col("_id").cast("string"))).cast("double"))
    nodes = nodes.select(F.col("_id").alias("node"), known("x").alias("x"), known("y").alias("y"))
    ways = _read(spark, path, "way", "_id long, nd array<struct<_ref:bigint>>").select(F.col("_id").alias("way"), F.posexplode("nd").alias("i", "nd")).select("way", "i", F.col("nd._ref").alias("node"))
    lines = ways.join(nodes, "node").groupBy("way").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("line"))
    lines = lines.select("way", F.transform("line", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))
    relations = _read(spark, path, "relation", f"_id long, member array<struct<_type:string,_ref:bigint,_role:string>>, {TAGS}").where(_tag("type") == "lanelet")
    members = relations.select(F.col("_id").alias("lanelet_id"), _tag("subtype").alias("subtype"), F.explode("member").alias("m")).where("m._role IN ('left', 'right')")
    sides = members.select("lanelet_id", "subtype", F.col("m._ref").alias("way"), F.col("m._role").alias("role")).join(lines, "way")
    both = sides.groupBy("lanelet_id", "subtype").agg(*(F.min(F.when(F.col("role") == r, F.col("line"))).alias(r) for r in ("left", "right"))).where("left IS NOT NULL AND right IS NOT NULL")
    end, first = F.element_at("left", -1), lambda line: F.element_at(line, 1)
    gap = lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])
    back = F.reverse("right")
    closing = F.when(gap(end, first(back)) <= gap(end, first(F.col("right"))), back).otherwise(F.col("right"))
    return repaired(both.select("lanelet_id", "subtype", F.concat("left", closing).alias("ring")).where("size(array_distinct(ring)) >= 3"))


def subtypes(lanes: DataFrame) -> list[str]:
    return sorted(r[0] for r in lanes.select("subtype").where("subtype IS NOT NULL").distinct().collect())


def region(lanes: DataFrame, subtypes: list[str] | None = None) -> DataFrame:
    """Lanes of some subtypes (None: all), for ``filters.in_map``; a subtype that is not there adds nothing."""
    return lanes.where(F.col("subtype").isin(subtypes)) if subtypes is not None else lanes


def polygons(lanes: DataFrame) -> list[list[tuple[float, float]]]:
    """Rings on the driver, for ``filters.by_map``: of a few lanes; ``filters.in_map`` joins any number."""
    return [[(p["x"], p["y"]) for p in r[0]] for r in lanes.orderBy("lanelet_id").select("ring").collect()]
