"""Counts by frame window over a stream of objects, and evaluation of frames as they become complete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sightline.functions.keys import frame_key
from sightline.operators.matching import Matcher, evaluate


def class_counts(stream: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, class, n): late rows beyond ``late`` are dropped, as watermarks have it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "class").agg(F.count("*").alias("n"))


def whole_frames(stream: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(ts, frame, rows): each frame once, when the watermark has passed its time.

    The rows of a frame carry the frame's own time; those later than ``late`` are dropped.
    """
    key = frame_key(stream)
    return stream.withWatermark(time, late).groupBy(time, *key).agg(F.collect_list(F.struct(*(c for c in stream.columns if c not in (time, *key)))).alias("rows"))


def evaluate_stream(stream: DataFrame, matcher: Matcher, sink: Callable[[DataFrame, int], None], checkpoint: str, time: str = "ts", late: str = "10 minutes") -> StreamingQuery:
    """Match frames as they become complete; ``stream`` has a boolean ``is_gt`` beside the columns of an entity."""
    key = frame_key(stream)

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.select(*key, F.explode("rows").alias("r")).select(*key, "r.*")
        est, gt = rows.where("NOT is_gt").drop("is_gt"), rows.where("is_gt").drop("is_gt")
        sink(evaluate(est, gt, matcher), number)

    return whole_frames(stream, time, late).writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint).start()
