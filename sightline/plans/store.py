"""Entities as append-only logs of chunks, their archetypes, and chunks as Arrow tables.

A row has ``frame``, ``chunk_seq`` (the write it came with), ``row_idx`` within its frame and its
components.  Empty frames are kept in a table of their own.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions.labels import LabelRegistry
from sightline.functions.keys import require
from sightline.plans.pipeline import _clean

INDEX = ("frame", "chunk_seq", "frame_id", "row_idx")
STEP = "struct<t:bigint,x:double,y:double>"
#: Components by name: type and the condition that a value meets.
COMPONENTS: dict[str, tuple[str, str]] = {
    **{c: ("double", "NOT isnan({0}) AND abs({0}) < double('Infinity')") for c in ("x", "y", "z", "qx", "qy", "qz", "qw", "w", "l", "h", "yaw", "tx", "ty", "tz")},
    **{c: ("double", "true") for c in ("vx", "vy", "vz")},
    **{c: ("int", "true") for c in ("rx", "ry", "rh", "rw", "num_points")},
    "class_id": ("int", "{0} >= -2"),
    "class": ("string", "true"),
    "confidence": ("double", "{0} BETWEEN 0 AND 1"),
    "instance": ("string", "true"),
    "instance_id": ("bigint", "true"),
    "visibility": ("int", "{0} BETWEEN -1 AND 3"),
    "mask": ("boolean", "true"),
    "image": ("array<array<int>>", "size({0}) > 0 AND forall({0}, r -> size(r) = size({0}[0]) AND size(r) > 0)"),
    "modes": (f"array<struct<confidence:double,steps:array<{STEP}>>>", "forall({0}, m -> m.confidence BETWEEN 0 AND 1)"),
    "future": (f"array<{STEP}>", "forall({0}, s -> s.t >= 0)"),
    "child": ("string", "length({0}) BETWEEN 1 AND 256"),
    "est_index": ("bigint", "{0} >= -1"),
    "gt_index": ("bigint", "{0} >= -1"),
    "status": ("int", "{0} BETWEEN 0 AND 2"),
    "support": ("bigint", "{0} >= 0"),
    "count": ("bigint", "{0} >= 0"),
}
BOX = ("x", "y", "z", "qx", "qy", "qz", "qw", "w", "l", "h", "class_id", "confidence")
EXTRA = ("vx", "vy", "vz", "num_points", "visibility")
#: Columns that an archetype must have, and those it may have.
ARCHETYPES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "detections3d": (BOX, EXTRA),
    "detections2d": (("rx", "ry", "rh", "rw", "class_id", "confidence"), ("visibility",)),
    "trackings3d": ((*BOX, "instance_id"), EXTRA),
    "trackings2d": (("rx", "ry", "rh", "rw", "class_id", "confidence", "instance_id"), ("visibility",)),
    "predictions3d": ((*BOX, "instance_id", "modes"), EXTRA),
    "trajectories3d": (("modes",), ()),
    "classifications2d": (("class_id", "confidence"), ("instance_id",)),
    "points": (("x", "y", "z"), ()),
    "semantic_points": (("x", "y", "z", "class_id"), ()),
    "semantic_image": (("image",), ()),
    "transform": (("tx", "ty", "tz", "qx", "qy", "qz", "qw", "child"), ()),
}
#: Flat columns that make one array where rows leave the engine.
VECTORS = {"position": ("x", "y", "z"), "quaternion": ("qx", "qy", "qz", "qw"), "size": ("w", "l", "h"), "velocity": ("vx", "vy", "vz"), "roi": ("rx", "ry", "rh", "rw"), "translation": ("tx", "ty", "tz")}


def component_type(name: str) -> str:
    if name not in COMPONENTS:
        raise KeyError(f"unknown component {name!r}")
    return COMPONENTS[name][0]


def checked(rows: DataFrame, archetype: str | None = None) -> DataFrame:
    """``rows`` with the archetype's columns in their types; a missing one raises now, a bad value when read.

    Nulls, values out of range and numbers that are not finite are bad.  Unknown velocities are NaN.
    """
    if archetype is not None:
        require(rows, *ARCHETYPES[archetype][0])
    out = {}
    for name in rows.columns:
        if name in COMPONENTS and name not in INDEX:
            kind, rule = COMPONENTS[name]
            value = F.col(name).cast(kind)
            ok = value.isNotNull() & F.expr(rule.format(f"`{name}`"))
            out[name] = F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(f"bad value of {name}: "), F.coalesce(F.col(name).cast("string"), F.lit("null")))).cast(kind))
    return rows.withColumns(out)


def from_columns(spark: SparkSession, columns: dict[str, list], archetype: str | None = None) -> DataFrame:
    """One partition from lists of equal length, numbered by ``row_idx``."""
    sizes = {len(v) for v in columns.values()}
    if len(sizes) > 1:
        raise ValueError(f"columns of different lengths: { {k: len(v) for k, v in columns.items()} }")
    n = sizes.pop() if sizes else 0
    schema = ", ".join([*(f"`{c}` {component_type(c)}" for c in columns), "row_idx bigint"])
    return checked(spark.createDataFrame([(*row, i) for i, row in zip(range(n), zip(*columns.values()))], schema), archetype)


def select_columns(rows: DataFrame, archetype: str) -> DataFrame:
    """The index and the archetype's columns, as far as they are there."""
    need, may = ARCHETYPES[archetype]
    require(rows, *need)
    return rows.select(*(c for c in rows.columns if c in (*INDEX, "recording", *need, *may)))


def positions(selection, length: int) -> list[int]:
    """Row numbers of a slice, a list of numbers (negative ones from the end) or of booleans."""
    if length < 0:
        raise ValueError(f"length {length}")
    if isinstance(selection, slice):
        return list(range(length))[selection]
    got = list(selection)
    if got and all(isinstance(x, bool) for x in got):
        if len(got) != length:
            raise ValueError(f"{len(got)} booleans for {length} rows")
        return [i for i, x in enumerate(got) if x]
    if any(isinstance(x, bool) or not isinstance(x, int) for x in got):
        raise TypeError("a selection is a slice, numbers or booleans")
    if any(not -length <= x < length for x in got):
        raise IndexError(f"a row number is out of range for {length} rows")
    return [x % length for x in got]


def select_rows(rows: DataFrame, selection) -> DataFrame:
    """Rows of one frame by :func:`positions`, numbered anew in the order selected."""
    at = positions(selection, rows.count())
    pick = rows.sparkSession.createDataFrame(list(zip(at, range(len(at)))), "row_idx bigint, _new bigint")
    return rows.join(F.broadcast(pick), "row_idx").withColumn("row_idx", F.col("_new")).drop("_new")


def narrow(rows: DataFrame, frames) -> DataFrame:
    """Rows of the frames at some positions (slice or numbers) of the sorted time axis."""
    axis = [r[0] for r in rows.select("frame").distinct().orderBy("frame").collect()] if not isinstance(frames, slice) or (frames.start or 0) < 0 or (frames.stop or 0) < 0 else None
    if axis is not None:
        return rows.where(F.col("frame").isin([axis[i] for i in positions(frames, len(axis))]))
    at = rows.select("frame").distinct().withColumn("_at", F.row_number().over(Window.orderBy("frame")) - 1)
    low, high, step = frames.start or 0, frames.stop, frames.step or 1
    keep = (F.col("_at") >= low) & ((F.col("_at") - low) % step == 0)
    return rows.join(at.where(keep if high is None else keep & (F.col("_at") < high)), "frame", "left_semi")


def same_values(a: Column, b: Column) -> Column:
    """Equality in which nulls are equal, and NaN too."""
    return a.eqNullSafe(b)


def concat(chunks: list[DataFrame]) -> DataFrame:
    """All rows of chunks with the same columns and types; other columns raise, and so do other coordinate frames."""
    if not chunks:
        raise ValueError("nothing to concatenate")
    kinds = [{f.name: f.dataType.simpleString() for f in c.schema} for c in chunks]
    if any(k != kinds[0] for k in kinds):
        raise ValueError("chunks with different columns")
    rows = reduce(lambda a, b: a.unionByName(b), chunks)
    if "frame_id" in rows.columns and len(chunks) > 1:
        stated = {r[0] for r in rows.select("frame_id").where("frame_id IS NOT NULL").distinct().limit(2).collect()}
        if len(stated) > 1:
            raise ValueError(f"chunks in different coordinate frames: {sorted(stated)}")
    return rows


@dataclass
class Store:
    """Chunks by entity.  A later write of a frame comes after an earlier one; static columns hold at all times."""

    spark: SparkSession
    chunks: dict[str, list[DataFrame]] = field(default_factory=dict)
    frames: dict[str, list[DataFrame]] = field(default_factory=dict)
    statics: dict[str, list[DataFrame]] = field(default_factory=dict)
    written: int = 0

    def log(self, path: str, rows: DataFrame, at: int, frame_id: str | None = None, archetype: str | None = None) -> None:
        """Append one partition, which may be empty, at time ``at``."""
        self.send(path, checked(rows, archetype).withColumn("frame", F.lit(at).cast("long")), frame_id)
        self.frames[_clean(path)].append(self.spark.range(1).select(F.lit(at).cast("long").alias("frame"), F.lit(self.written - 1).cast("long").alias("chunk_seq"), F.lit(0).cast("long").alias("n")))

    def send(self, path: str, rows: DataFrame, frame_id: str | None = None) -> None:
        """Append a chunk: rows of any number of frames, with ``frame`` and ``row_idx``."""
        require(rows, "frame", "row_idx")
        path = _clean(path)
        if frame_id is not None or "frame_id" not in rows.columns:
            rows = rows.withColumn("frame_id", F.lit(frame_id).cast("string"))
        self.chunks.setdefault(path, []).append(rows.withColumn("chunk_seq", F.lit(self.written).cast("long")))
        self.frames.setdefault(path, [])
        self.written += 1

    def log_static(self, path: str, row: DataFrame) -> None:
        self.statics.setdefault(_clean(path), []).append(row)

    def entity_paths(self) -> list[str]:
        return sorted({*self.chunks, *self.statics})

    def rows(self, path: str) -> DataFrame:
        if _clean(path) not in self.chunks:
            raise KeyError(f"no entity {path}")
        return concat(self.chunks[_clean(path)])

    def partitions(self, path: str) -> DataFrame:
        """(frame, chunk_seq, n): rows of each write of a frame, empty ones included."""
        counted = self.rows(path).groupBy("frame", "chunk_seq").agg(F.count("*").alias("n"))
        every = reduce(lambda a, b: a.unionByName(b), self.frames[_clean(path)], counted)
        return every.groupBy("frame", "chunk_seq").agg(F.sum("n").alias("n"))

    def times(self, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
        """(frame), sorted, of [low, high]; empty frames included."""
        rows = self.partitions(path).select("frame").distinct()
        rows = rows if low is None else rows.where(F.col("frame") >= low)
        return (rows if high is None else rows.where(F.col("frame") <= high)).orderBy("frame")

    def range(self, path: str, low: int | None = None, high: int | None = None, components: list[str] | None = None) -> DataFrame:
        """Rows of [low, high] by time, then write, then row; numbered anew within their frame."""
        rows = self.rows(path)
        rows = rows if low is None else rows.where(F.col("frame") >= low)
        rows = rows if high is None else rows.where(F.col("frame") <= high)
        again = F.row_number().over(Window.partitionBy("frame").orderBy("chunk_seq", "row_idx")) - 1
        rows = self._overlay(path, rows.withColumn("row_idx", again.cast("long")))
        return rows if components is None else rows.select(*(c for c in INDEX if c in rows.columns), *components)

    def latest_at(self, path: str, at: int, components: list[str] | None = None) -> DataFrame:
        """Rows of the newest write up to ``at``: of the newest frame, the last chunk.  It may be empty."""
        last = self.partitions(path).where(F.col("frame") <= at).agg(F.max(F.struct("frame", "chunk_seq")).alias("m")).select("m.frame", "m.chunk_seq")
        rows = self._overlay(path, self.rows(path).join(F.broadcast(last), ["frame", "chunk_seq"], "left_semi"))
        return rows if components is None else rows.select(*(c for c in INDEX if c in rows.columns), *components)

    def _overlay(self, path: str, rows: DataFrame) -> DataFrame:
        for row in self.statics.get(_clean(path), []):
            rows = rows.drop(*row.columns).crossJoin(F.broadcast(row.limit(1)))
        return rows


@dataclass(frozen=True)
class Recording:
    """A store that is only read, its labels and what is known about it."""

    store: Store
    labels: LabelRegistry | None = None
    instances: DataFrame | None = None
    metadata: dict = field(default_factory=dict)

    def range(self, path: str, *args, **kwargs) -> DataFrame:
        return self.store.range(path, *args, **kwargs)

    def latest_at(self, path: str, at: int, **kwargs) -> DataFrame:
        return self.store.latest_at(path, at, **kwargs)

    def times(self, path: str, *args) -> DataFrame:
        return self.store.times(path, *args)

    def entity_paths(self) -> list[str]:
        return self.store.entity_paths()

    def with_metadata(self, **more) -> Recording:
        return Recording(self.store, self.labels, self.instances, self.metadata | more)

    def agrees_with(self, other: Recording) -> bool:
        """Whether both give ids the same meaning."""
        mine, theirs = (r.labels and r.labels.fingerprint() for r in (self, other))
        return mine == theirs


# ---------------------------------------------------------------- at the border


def packed(rows: DataFrame) -> DataFrame:
    """Flat columns as arrays (position, quaternion, ...)."""
    for name, parts in VECTORS.items():
        if set(parts) <= set(rows.columns):
            rows = rows.withColumn(name, F.array(*parts)).drop(*parts)
    return rows


def unpacked(rows: DataFrame) -> DataFrame:
    """Arrays as flat columns; a null or an array of another length raises when read."""
    for name, parts in VECTORS.items():
        if name in rows.columns:
            kind = rows.schema[name].dataType
            ok = F.col(name).isNotNull() & (F.size(name) == len(parts)) & ~F.exists(name, lambda v: v.isNull())
            whole = F.when(ok, F.col(name)).otherwise(F.raise_error(F.lit(f"{name} needs {len(parts)} values")).cast(kind))
            rows = rows.withColumn(name, whole)
            rows = rows.withColumns({p: F.col(name)[i] for i, p in enumerate(parts)}).drop(name)
    return rows


def to_arrow(rows: DataFrame, path: str, labels: LabelRegistry | None = None) -> pa.Table:
    """A chunk as an Arrow table whose metadata hold its entity, version and labels; vectors are of fixed size."""
    table = packed(rows).orderBy("frame", "row_idx").toArrow()
    for name, parts in VECTORS.items():
        if name in table.column_names:
            i = table.column_names.index(name)
            table = table.set_column(i, name, table.column(i).cast(pa.list_(table.schema.field(i).type.value_type, len(parts))))
    about = {"entity": _clean(path), "version": 1, "labels": labels and json.loads(labels.to_json())}
    return table.replace_schema_metadata({"sightline": json.dumps(about)})


def from_arrow(spark: SparkSession, table: pa.Table) -> tuple[str, DataFrame, LabelRegistry | None]:
    """(entity, rows, labels) of :func:`to_arrow`; a table of another version raises."""
    about = json.loads((table.schema.metadata or {}).get(b"sightline", b"{}"))
    if about.get("version") != 1:
        raise ValueError("the table holds no chunk of version 1")
    if any(table.column(c).null_count for c in table.column_names if c in VECTORS or c in COMPONENTS):
        raise ValueError("a component holds nulls")
    kinds = [pa.list_(f.type.value_type) if pa.types.is_fixed_size_list(f.type) else f.type for f in table.schema]
    plain = table.cast(pa.schema([pa.field(f.name, k) for f, k in zip(table.schema, kinds)]))
    labels = LabelRegistry.from_json(json.dumps(about["labels"])) if about["labels"] else None
    return about["entity"], unpacked(spark.createDataFrame(plain)), labels


