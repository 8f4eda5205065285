"""One evaluation out of several sources: chosen entities under new paths, classes under one registry."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.labels import LabelRegistry
from sightline.operators.timeline import pair_times, reindex
from sightline.plans.pipeline import Catalog, Pipeline, _clean


@dataclass
class Source:
    """``paths`` maps an entity of ``catalog`` to its path in the evaluation.

    ``labels`` gives the meaning of ``class_columns`` (ids); ``instances(instance, instance_id)`` that of instance ids.
    """

    catalog: Catalog
    paths: dict[str, str]
    labels: LabelRegistry | None = None
    instances: DataFrame | None = None
    class_columns: tuple[str, ...] = ("class_id",)


@dataclass
class Evaluation:
    catalog: Catalog
    labels: LabelRegistry | None = None
    tags: dict[str, str] = field(default_factory=dict)

    def run(self, pipeline: Pipeline) -> Catalog:
        """The catalog with the pipeline's results beside what was assembled."""
        return pipeline.run(self.catalog)


def _frame_id(catalog: Catalog, path: str) -> str | None:
    row = catalog.static(path)
    return row.first()["frame_id"] if row is not None and "frame_id" in row.columns else None


def _same_instances(tables: list[DataFrame]) -> None:
    """An id that two sources give to different instances raises."""
    if len(tables) < 2:
        return
    every = tables[0].select("instance", "instance_id")
    for t in tables[1:]:
        every = every.unionByName(t.select("instance", "instance_id"))
    clash = every.groupBy("instance_id").agg(F.min("instance").alias("a"), F.max("instance").alias("b")).where("a <> b").first()
    if clash:
        raise ValueError(f"instance id {clash['instance_id']} is {clash['a']!r} and {clash['b']!r}")


def assemble(sources: list[Source], missing: str = "error", same_frame: bool = True, tags: dict[str, str] | None = None) -> Evaluation:
    """Entities of all sources, their classes as ids of the first source's registry.

    A class that the first registry lacks raises, or becomes unknown (``missing="unknown"``).  Two
    entities for one path, different frame ids and instance ids of two meanings raise too.
    """
    if not sources:
        raise ValueError("no sources")
    out, frames = Catalog(), {}
    target = next((s.labels for s in sources if s.labels), None)
    _same_instances([s.instances for s in sources if s.instances is not None])
    for s in sources:
        for path, new in s.paths.items():
            if _clean(new) in out.entities:
                raise ValueError(f"two entities for {new}")
            rows = s.catalog.get(path)
            if s.labels and s.labels != target:
                rows = rows.withColumns({c: s.labels.remap(target, F.col(c), missing) for c in s.class_columns if c in rows.columns})
            out.put(new, rows)
            static = s.catalog.static(path)
            if static is not None:
                out.put_static(new, static)
            if frame_id := _frame_id(s.catalog, path):
                frames[new] = frame_id
    if same_frame and len(set(frames.values())) > 1:
        raise ValueError(f"entities in different frames: {frames}")
    return Evaluation(out, target, dict(tags or {}))


def frame_pairs(reference: DataFrame, query: DataFrame, tolerance: int, offset: int = 0) -> DataFrame:
    """(reference, query): frames whose times lie within ``tolerance``, one to one; both sides are (frame, t)."""
    pairs = pair_times(reference, query, tolerance, offset)
    pairs = pairs.join(reference.select(F.col("t").alias("reference"), F.col("frame").alias("r")), "reference")
    pairs = pairs.join(query.select(F.col("t").alias("query"), F.col("frame").alias("q")), "query")
    return pairs.select(F.col("r").alias("reference"), F.col("q").alias("query"))


def align(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the query side at the reference's frames; frames without a partner go."""
    return reindex(rows, pairs)


def drop_frames(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the reference side whose frame has a partner."""
    return rows.join(pairs.select(F.col("reference").alias("frame")), "frame", "left_semi")


def assemble_pair(reference: Source, query: Source, times: tuple[DataFrame, DataFrame], tolerance: int, offset: int = 0, unmatched: str = "keep", **options) -> Evaluation:
    """Reference and query on one time axis; ``unmatched="drop"`` drops the reference's lone frames too."""
    if unmatched not in ("keep", "drop"):
        raise ValueError(f"unmatched: {unmatched}")
    out = assemble([reference, query], **options)
    pairs = frame_pairs(*times, tolerance, offset)
    for path in query.paths.values():
        out.catalog.put(path, align(out.catalog.get(path), pairs))
    if unmatched == "drop":
        for path in reference.paths.values():
            out.catalog.put(path, drop_frames(out.catalog.get(path), pairs))
    return out
