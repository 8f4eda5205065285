"""Metrics over joined verdicts (see :func:`sightline.operators.matching.evaluate`).

Each returns (class, value, support): class null is the row over all classes; an undefined value is
null; support counts ground truth.  ``classes`` is the registry's axis: its classes have a row even
where the data have none.  Verdicts are read once for each metric, or once and for its ranking.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions.geometry import PI, corner_displacement, heading_error
from sightline.functions.keys import frame_key
from sightline.operators.matching import FN, FP, TP

BACKGROUND, UNKNOWN, NO_CLASS = "background", -1, -2
#: Confidence steps that AP ranks apart from each other, so that no class is sorted in one task.
STEPS = 4096


def values(spark: SparkSession, items: list, name: str, kind: str) -> DataFrame:
    """A column of a few literals, as part of the plan."""
    return spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in items)).cast(f"array<{kind}>")).alias(name))


def _on_axis(rows: DataFrame, classes: list | None, zero: tuple = ()) -> DataFrame:
    """One row for each class of the axis (default: of those seen), and the row over all."""
    if classes is None:
        return rows
    axis = values(rows.sparkSession, classes, "class", rows.schema["class"].dataType.simpleString())
    own = axis.join(rows, "class", "left").unionByName(rows.where("class IS NULL"))
    return own.withColumns({c: F.coalesce(c, F.lit(0)).cast(rows.schema[c].dataType) for c in zero})


def _pooled(rows: DataFrame, *aggs: Column) -> DataFrame:
    """Aggregates by class and over all (class null) in one shuffle."""
    return rows.where("class IS NOT NULL").rollup("class").agg(*aggs)


def _tally(joined: DataFrame) -> DataFrame:
    """(class, est, gt, tp, score, fp) by class and over all: each verdict gives its sides' shares."""
    hit = F.col("label_correct").cast("long")
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    est = F.struct(F.col("e_class").alias("class"), F.lit(1).cast("long").alias("est"), zero.alias("gt"), zero.alias("tp"), none.alias("score"), (F.col("status") == FP).cast("long").alias("fp"))
    gt = F.struct(F.col("g_class").alias("class"), zero.alias("est"), F.lit(1).cast("long").alias("gt"), hit.alias("tp"), F.when(hit == 1, F.col("score")).otherwise(0.0).alias("score"), zero.alias("fp"))
    rows = joined.select(F.explode(F.array(est, gt)).alias("r")).select("r.*")
    return _pooled(rows, *(F.sum(c).alias(c) for c in ("est", "gt", "tp", "score", "fp")))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def average_precision(joined: DataFrame, classes: list | None = None, heading: bool = False, min_recall: float = 0.1, min_precision: float = 0.1, points: int = 101, by: tuple = ()) -> DataFrame:
    """Area above ``min_precision`` of the precision envelope on a recall grid; the row over all is the mean.

    Estimates rank by confidence, then the later row first; unknown confidences last.  With
    ``heading`` a hit weighs 1 - |yaw error| / pi, in recall too.  Ranks are running sums within
    steps of confidence, plus what the steps before hold; of the curve only its first and last
    point and its best precision between two grid points are kept.  ``by`` names columns that hold
    evaluations apart.
    """
    group, order = [*by, "class"], [F.desc_nulls_last("c"), *(F.desc(c) for c in frame_key(joined)), F.desc("est_index")]
    weight = F.when(F.col("label_correct"), 1 - heading_error(F.col("e_yaw"), F.col("g_yaw")) / PI if heading else 1.0).otherwise(0.0)
    est = joined.where("e_class IS NOT NULL").select(*by, F.col("e_class").alias("class"), *frame_key(joined), "est_index", F.col("e_confidence").alias("c"), weight.alias("hit"))
    est = est.withColumn("miss", (F.col("hit") <= 0).cast("double")).withColumn("step", F.coalesce(F.least(F.greatest(F.floor(F.col("c") * STEPS), F.lit(0)), F.lit(STEPS)), F.lit(-1)))
    gt = joined.where("g_class IS NOT NULL").groupBy(*by, F.col("g_class").alias("class")).agg(F.count("*").alias("gt"))
    before = Window.partitionBy(*group).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = est.groupBy(*group, "step").agg(F.sum("hit").alias("t"), F.sum("miss").alias("f"), F.count("*").alias("n"))
    total = Window.partitionBy(*group)
    steps = steps.select(*group, "step", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "tfn"), F.sum("n").over(total).alias("est"))
    running = Window.partitionBy(*group, "step").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    curve = est.join(steps, [*group, "step"]).join(gt, group, "left")
    curve = curve.select(*group, "est", "gt", (F.col("n0") + F.count("*").over(running)).alias("k"), (F.col("t0") + F.sum("hit").over(running)).alias("tp"), (F.col("f0") + F.sum("miss").over(running)).alias("fp"))
    last = float(points - 1)
    curve = curve.select(*group, "est", "k", (F.col("tp") / F.col("gt")).alias("r"), (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1e-12))).alias("p"))
    # grid point `cell` is the first at or right of the recall; a class without ground truth has no recall
    cells = curve.groupBy(*group, F.ceil(F.col("r") * last - 1e-9).cast("int").alias("cell")).agg(F.max("est").alias("est"), F.min("r").alias("first"), F.max("r").alias("last"), F.max_by("p", "k").alias("p"), F.max("p").alias("best"))
    along = Window.partitionBy(*group).orderBy("cell")
    after = F.max("best").over(along.rowsBetween(1, Window.unboundedFollowing))
    cells = cells.select(*group, "est", "cell", "last", F.max("best").over(total).alias("top"), F.min("cell").over(total).alias("start"), F.greatest("p", after).alias("here"), after.alias("next"), F.lead("first").over(along).alias("r1"), F.lead("cell").over(along).alias("end"))
    low = round(last * min_recall) + 1
    at = F.col("i") / last
    stop = F.when(F.col("end").isNotNull(), F.col("end") - 1).otherwise(F.floor(F.col("last") * last + 1e-9).cast("int"))
    begin = F.when(F.col("cell") == F.col("start"), F.lit(0)).otherwise(F.col("cell"))
    grid = cells.withColumn("i", F.explode_outer(F.when(stop >= begin, F.sequence(begin, stop)))).withColumn("i", F.when((F.col("i") >= low) & (F.col("i") < points), F.col("i")))
    value = F.when(F.col("i") < F.col("cell"), F.col("top")).when(F.col("end").isNull(), F.col("here")).otherwise(F.col("here") + (F.col("next") - F.col("here")) * F.greatest(at - F.col("last"), F.lit(0.0)) / (F.col("r1") - F.col("last")))
    area = grid.groupBy(*group).agg(F.sum(F.when(F.col("i").isNotNull(), F.greatest(value - min_precision, F.lit(0.0)))).alias("area"), F.max("est").alias("est"))
    rows = gt.join(area, group, "full")
    ap = F.coalesce("area", F.lit(0.0)) / (points - low) / (1 - min_precision)
    rows = rows.select(*group, F.when(F.col("gt").isNotNull(), ap).otherwise(0.0).alias("value"), F.coalesce("gt", F.lit(0)).cast("long").alias("support"))
    if classes is not None:
        axis = values(rows.sparkSession, classes, "class", rows.schema["class"].dataType.simpleString())
        axis = rows.select(*by).distinct().join(F.broadcast(axis)) if by else axis
        rows = axis.join(rows, group, "left").select(*group, "value", F.coalesce("support", F.lit(0)).cast("long").alias("support"))
    return _with_mean(rows, by)


def _with_mean(rows: DataFrame, by: tuple) -> DataFrame:
    mean = rows.groupBy(*by).agg(F.avg("value").alias("value"), F.coalesce(F.sum("support"), F.lit(0)).cast("long").alias("support"))
    return rows.unionByName(mean.withColumn("class", F.lit(None).cast(rows.schema["class"].dataType)).select(*rows.columns))


def mean_average_precision(tables: list[tuple[float, DataFrame]] | DataFrame) -> DataFrame:
    """(class, threshold, value, support): means over thresholds, over classes, and of the classes' means.

    From a table (threshold, class, value, support) or a list of AP tables with their thresholds.
    """
    if isinstance(tables, DataFrame):
        rows = tables.where("class IS NOT NULL").select("class", "threshold", "value", "support")
    else:
        rows = None
        for t, frame in tables:
            one = frame.where("class IS NOT NULL").withColumn("threshold", F.lit(float(t))).select("class", "threshold", "value", "support")
            rows = one if rows is None else rows.unionByName(one)
    kind, level = rows.schema["class"].dataType, F.grouping_id()
    sets = rows.groupingSets([["class"], ["threshold"]], "class", "threshold").agg(level.alias("level"), F.avg("value").alias("value"), F.max("support").alias("most"), F.sum("support").alias("all"))
    # grouping_id 1: a class over thresholds; 2: a threshold over classes
    one = sets.select("class", "threshold", "value", F.when(F.col("level") == 1, F.col("most")).otherwise(F.col("all")).alias("support"), "level")
    total = one.where("level = 1").agg(F.avg("value").alias("value"), F.sum("support").alias("support"))
    total = total.select(F.lit(None).cast(kind).alias("class"), F.lit(None).cast("double").alias("threshold"), "value", "support")
    return one.drop("level").unionByName(total)


def id_switches(joined: DataFrame) -> DataFrame:
    """(class, switches): another estimate instance than in the frame before that had hits.

    The frame before is the last one with any hit of the class (or, in the row over all, of any), of
    the same recording.
    """
    key = frame_key(joined)
    apart = key[:-1]
    pools = F.array(F.struct(F.col("g_class").alias("class"), F.lit(False).alias("pool")), F.struct(F.lit(None).cast(joined.schema["g_class"].dataType).alias("class"), F.lit(True).alias("pool")))
    hits = joined.where("label_correct").select(*key, F.col("g_instance").alias("g"), F.col("e_instance").alias("e"), F.explode(pools).alias("p"))
    hits = hits.groupBy(*key, "g", "p").agg(F.max("e").alias("e"))
    seen = hits.select(*key, "p").distinct().withColumn("before", F.lag("frame").over(Window.partitionBy(*apart, "p").orderBy("frame")))
    own = Window.partitionBy(*apart, "p", "g").orderBy("frame")
    moved = hits.withColumn("was", F.lag("e").over(own)).withColumn("at", F.lag("frame").over(own)).where("e <> was")
    return moved.join(seen, [*key, "p"]).where("at = before").groupBy("p").agg(F.count("*").alias("switches")).select(F.col("p.class").alias("class"), "switches")


def clear(joined: DataFrame, classes: list | None = None) -> DataFrame:
    """(class, mota, motp, id_switch, support); MOTA is not clamped."""
    rows = _on_axis(_tally(joined), classes, ("est", "gt", "tp", "fp"))
    rows = rows.join(id_switches(joined).withColumnRenamed("class", "sc"), F.expr("class <=> sc"), "left")
    switches = F.coalesce("switches", F.lit(0))
    return rows.select("class", _ratio((F.col("tp") - F.col("fp") - switches).cast("double"), F.col("gt")).alias("mota"), _ratio(F.col("score"), F.col("tp")).alias("motp"), switches.cast("long").alias("id_switch"), F.col("gt").cast("long").alias("support"))


def classification(joined: DataFrame, classes: list | None = None) -> DataFrame:
    """(class, accuracy, precision, recall, f1, support)."""
    rows = _on_axis(_tally(joined), classes, ("est", "gt", "tp"))
    tp, est, gt = (F.col(c).cast("double") for c in ("tp", "est", "gt"))
    p, r = _ratio(tp, est), _ratio(tp, gt)
    return rows.select("class", _ratio(tp, est + gt - tp).alias("accuracy"), p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"), F.col("gt").cast("long").alias("support"))


def _dense(got: DataFrame, classes: list, background) -> DataFrame:
    """Counts of all pairs of classes and background; a class off the axis raises."""
    kind = got.schema["gt_class"].dataType.simpleString()
    every = [*classes, background]
    axis = values(got.sparkSession, every, "gt_class", kind).withColumn("est_class", F.explode(F.array(*(F.lit(x) for x in every)).cast(f"array<{kind}>"))).withColumn("on", F.lit(True))
    rows = axis.join(got, ["gt_class", "est_class"], "full")
    lost = F.raise_error(F.concat(F.lit("classes off the axis: "), F.col("gt_class").cast("string"), F.lit(", "), F.col("est_class").cast("string"))).cast("long")
    return rows.select("gt_class", "est_class", F.when(F.col("on"), F.coalesce("count", F.lit(0)).cast("long")).otherwise(lost).alias("count"))


def confusion(joined: DataFrame, classes: list) -> DataFrame:
    """(gt_class, est_class, count), zeros included; a side without a partner is "background".

    A class that is not on the axis raises, and so does a status that its indices contradict.
    """
    e, g = F.col("e_class").isNotNull(), F.col("g_class").isNotNull()
    fits = F.when(F.col("status") == TP, e & g).when(F.col("status") == FP, e & ~g).when(F.col("status") == FN, ~e & g)
    gt = F.when(fits, F.coalesce("g_class", F.lit(BACKGROUND))).otherwise(F.raise_error(F.lit("a status contradicts its indices")).cast("string"))
    got = joined.groupBy(gt.alias("gt_class"), F.coalesce("e_class", F.lit(BACKGROUND)).alias("est_class")).agg(F.count("*").alias("count"))
    return _dense(got, classes, BACKGROUND)


def _over_hits(joined: DataFrame, error: Column, classes: list | None, *aggs: Column) -> DataFrame:
    hits = joined.where("label_correct").select(F.col("g_class").alias("class"), error.alias("error"))
    rows = _pooled(hits, *aggs, F.count("*").alias("hits"))
    return _on_axis(rows, classes, ("hits",))


def corner_error(joined: DataFrame, percentile: float = 95, classes: list | None = None) -> DataFrame:
    """(class, mean, max, p, hits) of the corner gap of label-correct pairs; the percentile is exact."""
    full = all(f"{s}_q{k}" in joined.columns for s in "eg" for k in "xyzw")
    return _over_hits(joined, corner_displacement("e_", "g_", full), classes, F.avg("error").alias("mean"), F.max("error").alias("max"), F.percentile("error", F.lit(percentile / 100)).alias("p"))


def heading_flip_rate(joined: DataFrame, limit: float = math.pi / 2, classes: list | None = None) -> DataFrame:
    error = heading_error(F.col("e_yaw"), F.col("g_yaw"))
    return _over_hits(joined, error, classes, F.avg((F.col("error") > limit + 1e-9).cast("double")).alias("value"))


def fp_validation(joined: DataFrame, label) -> DataFrame:
    """(instance, frames, passes, fails, pass_rate) of ground truth that must not be found; null: all."""
    key = frame_key(joined)
    rows = joined.where(F.col("g_class") == F.lit(label))
    aggs = (F.countDistinct(*key).alias("frames"), F.count_if(F.col("status") == FN).alias("passes"), F.count_if(F.col("status") == TP).alias("fails"))
    by = rows.groupBy(F.col("g_instance").alias("instance")).agg(*aggs)
    every = rows.agg(*aggs).withColumn("instance", F.lit(None).cast(by.schema["instance"].dataType))
    return by.unionByName(every.select(*by.columns)).withColumn("pass_rate", _ratio(F.col("passes").cast("double"), F.col("passes") + F.col("fails")))


def fp_validation_by_class(joined: DataFrame, label, classes: list) -> DataFrame:
    """(class, value, support) on the registry's axis: the pass rate of ``label``, null for other classes."""
    tally = joined.where(F.col("g_class") == F.lit(label)).agg(F.count_if(F.col("status") == FN).alias("passes"), F.count("*").alias("n"))
    axis = values(joined.sparkSession, classes, "class", joined.schema["g_class"].dataType.simpleString()) if classes else None
    rate = _ratio(F.col("passes").cast("double"), F.col("n"))
    every = tally.select(F.lit(None).cast(joined.schema["g_class"].dataType).alias("class"), rate.alias("value"), F.col("n").alias("support"))
    if axis is None:
        return every
    own = F.col("class") == F.lit(label)
    rows = axis.join(F.broadcast(tally)).select("class", F.when(own, rate).alias("value"), F.when(own, F.col("n")).otherwise(0).cast("long").alias("support"))
    return rows.unionByName(every.withColumn("value", F.when(F.lit(label in classes), F.col("value"))))


# ---------------------------------------------------------------- segmentation


def pixels(images: DataFrame, column: str = "image", label: str = "class") -> DataFrame:
    """Label images ``array<array<int>>`` as elements (frame, elem_idx, label, height, width), row by row.

    Rows of different length raise, and so does an image without pixels.
    """
    key = frame_key(images)
    high, wide = F.size(column), F.size(F.get(column, F.lit(0)))
    even = (high > 0) & (wide > 0) & F.forall(column, lambda row: F.size(row) == wide)
    checked = F.when(even, F.col(column)).otherwise(F.raise_error(F.lit("an image needs rows of one length")).cast(images.schema[column].dataType))
    return images.select(*key, high.alias("height"), wide.alias("width"), F.posexplode(F.flatten(checked)).alias("elem_idx", label)).withColumn("elem_idx", F.col("elem_idx").cast("long"))


def elements(est: DataFrame, gt: DataFrame, tolerance: float | None = 1e-6) -> DataFrame:
    """(frame, elem_idx, gt_class, est_class): both sides' labels ``class``, element by element.

    A side that lacks an element raises, images of different shapes (``height width``) raise, and
    where both sides carry ``x y z`` a pair more than ``tolerance`` apart raises.
    """
    key = [*frame_key(est, gt), "elem_idx"]
    e, g = side_of(est, "e_", key), side_of(gt, "g_", key)
    both = e.join(g, key, "full")
    label = F.col("g_class")
    fail = lambda text: F.raise_error(F.lit(text)).cast("int")
    if {"x", "y", "z"} <= set(est.columns) & set(gt.columns) and tolerance is not None:
        gap = F.sqrt(sum(((F.col(f"e_{k}") - F.col(f"g_{k}")) * (F.col(f"e_{k}") - F.col(f"g_{k}")) for k in "xyz"), F.lit(0.0)))
        label = F.when(gap > tolerance, fail("the sides hold different points")).otherwise(label)
    if {"height", "width"} <= set(est.columns) & set(gt.columns):
        label = F.when((F.col("e_height") != F.col("g_height")) | (F.col("e_width") != F.col("g_width")), fail("the images have different shapes")).otherwise(label)
    if "frame_id" in est.columns and "frame_id" in gt.columns:
        label = F.when(F.col("e_frame_id") != F.col("g_frame_id"), fail("labels in different coordinate frames")).otherwise(label)
    label = F.when(F.col("e__here").isNull() | F.col("g__here").isNull(), fail("the sides label different elements")).otherwise(label)
    return both.select(*key, label.alias("gt_class"), F.col("e_class").alias("est_class"))


def side_of(rows: DataFrame, prefix: str, key: list[str]) -> DataFrame:
    return rows.select(*key, *(F.col(c).alias(prefix + c) for c in rows.columns if c not in key), F.lit(True).alias(f"{prefix}_here"))


def segmentation_confusion(elements: DataFrame, classes: list[int] | None, ignore: list | None = None) -> DataFrame:
    """(gt_class, est_class, count) over ``classes`` and background (-2), zeros included.

    Unknown (-1) and ignored ground truth does not count, and ignored classes leave the axis; an
    estimate off the axis is background; ground truth off it raises.  Without ``classes`` those
    seen make the axis and only pairs that occur are returned.
    """
    out = [UNKNOWN, *(ignore or [])]
    rows = elements.where(~F.col("gt_class").isin(out))
    if classes is None:
        est = F.when(F.col("est_class").isin(out) | (F.col("est_class") < 0), NO_CLASS).otherwise(F.col("est_class"))
        return rows.groupBy("gt_class", est.alias("est_class")).agg(F.count("*").alias("count"))
    axis = [c for c in classes if c not in out]
    est = F.when(F.col("est_class").isin(axis), F.col("est_class")).otherwise(NO_CLASS)
    return _dense(rows.groupBy("gt_class", est.alias("est_class")).agg(F.count("*").alias("count")), axis, NO_CLASS)


def segmentation(elements: DataFrame, ignore: list | None = None, classes: list[int] | None = None) -> DataFrame:
    """(class, iou, accuracy, support) of ``elements(gt_class, est_class)``; null: means and pixel accuracy.

    What counts is said at :func:`segmentation_confusion`.
    """
    cells = segmentation_confusion(elements, classes, ignore)
    n, same = F.col("count"), F.col("gt_class") == F.col("est_class")
    gt = F.struct(F.col("gt_class").alias("class"), F.when(same, n).otherwise(0).alias("tp"), n.alias("gt"), F.lit(0).cast("long").alias("est"))
    est = F.struct(F.col("est_class").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("gt"), n.alias("est"))
    by = cells.select(F.explode(F.array(gt, est)).alias("r")).select("r.*").groupBy("class").agg(*(F.sum(c).alias(c) for c in ("tp", "gt", "est"))).where("class >= 0")
    union = F.col("gt") + F.col("est") - F.col("tp")
    one = by.select("class", _ratio(F.col("tp").cast("double"), union).alias("iou"), _ratio(F.col("tp").cast("double"), F.col("gt")).alias("accuracy"), "tp", F.col("gt").cast("long").alias("support"))
    every = one.agg(F.avg("iou").alias("iou"), F.avg("accuracy").alias("accuracy"), _ratio(F.sum("tp").cast("double"), F.sum("support")).alias("pixel_accuracy"), F.coalesce(F.sum("support"), F.lit(0)).alias("support"))
    kind = one.schema["class"].dataType
    return one.select("class", "iou", "accuracy", F.lit(None).cast("double").alias("pixel_accuracy"), "support").unionByName(every.select(F.lit(None).cast(kind).alias("class"), "iou", "accuracy", "pixel_accuracy", "support"))


# ---------------------------------------------------------------- readers


def as_matrix(counts: DataFrame, classes: list) -> DataFrame:
    """A confusion table with a column for each estimated class of ``classes``."""
    return counts.groupBy("gt_class").pivot("est_class", classes).agg(F.sum("count"))


def of_class(values: DataFrame, label) -> DataFrame:
    """A metric's row of one class; None: of all classes.  No row, or several, raise."""
    one = values.where(F.col("class").eqNullSafe(F.lit(label))).limit(2)
    fail = F.raise_error(F.lit(f"not one row of class {label}"))
    checked = one.agg(F.count("*").alias("n"), F.first(F.struct(*values.columns)).alias("row"))
    return checked.select(F.when(F.col("n") == 1, F.col("row")).otherwise(fail.cast(checked.schema["row"].dataType)).alias("row")).select("row.*")
