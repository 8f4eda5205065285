"""One-to-one matching of estimates with ground truth, frame by frame.

Pairs are an equi-join on the frame (of a recording), the class where classes must agree, and for
distances a slab as wide as the threshold; the score and the gates are columns.  Greedy assignment by
the library's scores makes no pairs: Arrow groups of a frame (and class) take their turns in memory
that grows with their rows.  By a score of one's own it passes once over the sorted pairs.  Optimal
assignment runs on Arrow groups of pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from sightline.functions import geometry as G
from sightline.functions.kernels import KERNELS
from sightline.functions.keys import frame_key, require
from sightline.operators.greedy import KINDS, assign_groups, assign_pairs, score_groups

TP, FP, FN = 0, 1, 2
#: Score, whether larger is better, default threshold.
SCORES = {
    "center_distance": (G.center_distance, False, 1.0),
    "bev_distance": (G.bev_distance, False, 1.0),
    "plane_distance": (G.plane_distance, False, 2.0),
    "iou_bev": (G.bev_iou, True, 0.5),
    "iou_3d": (G.volume_iou, True, 0.5),
    "iou_roi": (G.roi_iou, True, 0.5),
}
#: Scores that need a rotation, and those that bound the distance along x.
TURNED, NEAR = ("plane_distance", "iou_bev", "iou_3d"), ("center_distance", "bev_distance")


@dataclass(frozen=True)
class Matcher:
    """What makes a pair feasible.  Thresholds go by the ground truth's class.

    ``score`` is one of ``SCORES`` or a function of the prefixes of both sides that returns a
    column; then ``larger`` says which way is better and ``threshold`` must be given.
    """

    score: str | Callable[[str, str], Column] = "center_distance"
    threshold: float | None = None
    by_class: dict = field(default_factory=dict)
    class_agnostic: bool = False
    agnostic_classes: tuple = ()
    max_distance: float | None = None
    assignment: str = "optimal"
    larger: bool | None = None
    check_frames: bool = True

    def __post_init__(self):
        if self.assignment not in ("greedy", "optimal") or not callable(self.score) and self.score not in SCORES:
            raise ValueError("unknown score or assignment")
        if callable(self.score) and (self.larger is None or self.threshold is None):
            raise ValueError("a score of one's own needs `larger` and a threshold")
        for t in (self.limit, *self.by_class.values()):
            if not callable(self.score) and (t <= 0 or self.better and t > 1):
                raise ValueError(f"threshold {t} is out of range")
        if self.class_agnostic and self.agnostic_classes:
            raise ValueError("all classes are agnostic already")

    @property
    def better(self) -> bool:
        """Whether larger scores are better."""
        return self.larger if callable(self.score) else SCORES[self.score][1]

    @property
    def limit(self) -> float:
        return SCORES[self.score][2] if self.threshold is None else self.threshold

    @property
    def reach(self) -> float | None:
        """The largest distance along x of a pair, where there is one."""
        widest = [max([self.limit, *self.by_class.values()])] if self.score in NEAR else []
        return min([*widest, *([] if self.max_distance is None else [self.max_distance])], default=None)

    def threshold_of(self, label: Column) -> Column:
        out = F.lit(float(self.limit))
        for k, t in sorted(self.by_class.items()):
            out = F.when(label == k, float(t)).otherwise(out)
        return out

    def measure(self, est: DataFrame, gt: DataFrame) -> Column:
        """The score of a pair; footprints follow the whole rotation where both sides have one."""
        if callable(self.score):
            return self.score("e_", "g_")
        full = all({"qx", "qy", "qz", "qw"} <= set(t.columns) for t in (est, gt))
        return SCORES[self.score][0]("e_", "g_", full) if self.score in TURNED and full else SCORES[self.score][0]("e_", "g_")

    def coordinates(self, full: bool) -> dict[str, Column]:
        """What greedy assignment reads of a row."""
        if self.score in KERNELS:
            own = G.readied(self.score, full)
            return own | ({} if self.max_distance is None else {f"_{k}": F.col(k) for k in "xyz"})
        return {f"_{k}": F.col(k) for k in ("xyz" if self.score == "center_distance" or self.max_distance is not None else "xy")}


def side(rows: DataFrame, prefix: str, key: list[str]) -> DataFrame:
    return rows.select(*key, *(F.col(c).alias(prefix + c) for c in rows.columns if c not in key))


def sides(est: DataFrame, gt: DataFrame, reach: float | None = None) -> DataFrame:
    """All pairs of a frame (with ``reach``: a superset of those so near along x), prefixed e_ and g_."""
    key = frame_key(est, gt)
    e, g = side(est, "e_", key), side(gt, "g_", key)
    if reach is None or not np.isfinite(reach):
        return e.join(g, key)
    slab = lambda c: F.floor(F.col(c) / (reach * (1 + 1e-9))).cast("long")
    e = e.withColumn("_slab", F.explode(F.array(*(slab("e_x") + k for k in (-1, 0, 1)))))
    return e.join(g.withColumn("_slab", slab("g_x")), [*key, "_slab"]).drop("_slab")


def feasible(est: DataFrame, gt: DataFrame, m: Matcher) -> DataFrame:
    """(frame, e, g, confidence, score) of pairs that may be matched.

    Pairs whose sides state different coordinate frames (``frame_id``) raise.
    """
    for rows in (est, gt):
        require(rows, "row_idx", "class")
    pairs = sides(est, gt, m.reach)
    same = F.col("e_class") == F.col("g_class")
    if m.agnostic_classes:
        same = same | (F.col("e_class").isin(list(m.agnostic_classes)) & F.col("g_class").isin(list(m.agnostic_classes)))
    if not m.class_agnostic:
        pairs = pairs.where(same)
    if m.max_distance is not None:
        pairs = pairs.where(G.center_distance("e_", "g_") <= m.max_distance)
    limit = m.threshold_of(F.col("g_class"))
    measure = m.measure(est, gt)
    if m.check_frames and "frame_id" in est.columns and "frame_id" in gt.columns:
        measure = F.when(F.col("e_frame_id") != F.col("g_frame_id"), F.raise_error(F.lit("pairs across coordinate frames")).cast("double")).otherwise(measure)
    score = F.col("score")
    ok = ~F.isnan(score) & (score >= limit if m.better else score <= limit)
    rows = pairs.withColumn("score", measure).where(ok)
    sure = F.col("e_confidence") if "confidence" in est.columns else F.lit(None).cast("double")
    if m.assignment == "greedy":
        require(est, "confidence")
    return rows.select(*frame_key(est, gt), F.col("e_row_idx").alias("e"), F.col("g_row_idx").alias("g"), sure.alias("confidence"), "score")


def assign_greedy(pairs: DataFrame, larger: bool, key: list[str] | None = None) -> DataFrame:
    """Surest estimate first (then the later row); each takes its best free partner (then the earlier row).

    Estimates without a confidence come last.
    """
    key = key or frame_key(pairs)
    sure = F.coalesce(-F.col("confidence"), F.lit(float("inf")))
    rows = pairs.select(*key, sure.alias("_sure"), (-F.col("e")).cast("long").alias("_turn"), (-F.col("score") if larger else F.col("score")).alias("s"), F.col("g").cast("long").alias("g"))
    rows = rows.repartition(*key).sortWithinPartitions(*key, "_sure", "_turn", "s", "g")
    got = rows.mapInArrow(lambda batches: assign_pairs(batches, key), rows.schema)
    return got.select(*key, (-F.col("_turn")).alias("e"), "g", (-F.col("s") if larger else F.col("s")).alias("score"))


def _packed(rows: DataFrame, known: list[str], key: list[str], is_gt: bool, other: dict[str, Column], at: dict[str, Column]) -> DataFrame:
    """Rows of a side for Arrow groups: those whose key and ``known`` columns are not null, since null meets nothing."""
    rows = rows.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in (*key, *known))))
    if "_points" in at:  # corners once for all that read them
        rows = rows.withColumn("_points", at["_points"])
    return rows.select(*key, F.lit(is_gt).alias("_gt"), F.col("row_idx").cast("long").alias("_id"), *(c.alias(k) for k, c in other.items()), *(c.cast("double").alias(k) for k, c in at.items() if k != "_points"))


def scored(est: DataFrame, gt: DataFrame, score: str) -> DataFrame:
    """(frame, e, g, score) of all pairs of a frame and class, by a kernel.

    Each class of a frame goes out in four parts of its estimates; a task holds the rows of one, not its pairs.
    """
    key = frame_key(est, gt)
    full = score != "iou_roi" and all({"qx", "qy", "qz", "qw"} <= set(t.columns) for t in (est, gt))
    at, by = G.readied(score, full), [*key, "_class", "_part"]
    parts = F.explode(F.array(*(F.lit(i).cast("long") for i in range(4))))
    rows = _packed(est, ["class"], key, False, {"_class": F.col("class"), "_part": F.pmod(F.col("row_idx").cast("long"), F.lit(4).cast("long"))}, at)
    rows = rows.unionByName(_packed(gt, ["class"], key, True, {"_class": F.col("class"), "_part": F.lit(0).cast("long")}, at).withColumn("_part", parts))
    schema = StructType([rows.schema[k] for k in key]).add("e", LongType()).add("g", LongType()).add("score", DoubleType())
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda batches: score_groups(batches, by, key, score), schema)


def assign_in_turn(est: DataFrame, gt: DataFrame, m: Matcher, cuts: tuple | None = None) -> DataFrame:
    """:func:`assign_greedy` of the feasible pairs, which are not made; with ``cuts`` at each of these thresholds (column ``cut``).

    Groups in which both sides state different coordinate frames (``frame_id``) raise.
    """
    key = frame_key(est, gt)
    for rows in (est, gt):
        require(rows, "row_idx", "class")
    require(est, "confidence")
    one = F.coalesce(F.col("class").isin(list(m.agnostic_classes)), F.lit(False)) if m.agnostic_classes else F.lit(False)
    group = {} if m.class_agnostic else {"_pool": one, "_class": F.when(~one, F.col("class"))}
    stated = m.check_frames and "frame_id" in est.columns and "frame_id" in gt.columns
    full = all({"qx", "qy", "qz", "qw"} <= set(t.columns) for t in (est, gt))

    def pack(rows: DataFrame, is_gt: bool) -> DataFrame:
        sure = F.lit(0.0) if is_gt else F.coalesce(-F.col("confidence"), F.lit(float("inf"))).cast("double")
        other = {**group, "_sure": sure, "_limit": m.threshold_of(F.col("class")), **({"_coords": F.col("frame_id")} if stated else {})}
        return _packed(rows, [] if m.class_agnostic else ["class"], key, is_gt, other, m.coordinates(full))

    rows = pack(est, False).unionByName(pack(gt, True))
    by = [*key, *group]
    schema = StructType([rows.schema[k] for k in key])
    if cuts:
        schema = schema.add("cut", DoubleType())
    schema = schema.add("e", LongType()).add("g", LongType()).add("score", DoubleType())
    kind, gate = m.score, m.max_distance
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda batches: assign_groups(batches, by, key, kind, gate, cuts), schema)


def solve(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest assignment (rows <= columns): shortest augmenting paths."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], col = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[col] = True
            row = match[col]
            slack = np.where(used[1:], np.inf, cost[row - 1] - u[row] - v[1:])
            better = slack < least[1:]
            least[1:][better], way[1:][better] = slack[better], col
            nxt = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            step = least[nxt]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            col = nxt
            if match[col] == 0:
                break
        while col:
            match[col] = match[way[col]]
            col = way[col]
    out = np.zeros(n, int)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def assign_optimal(pairs: DataFrame, larger: bool, key: list[str] | None = None) -> DataFrame:
    """As many pairs as possible, then the least total cost; a frame is solved in one group."""
    key = key or frame_key(pairs)

    def run(pdf):
        es, e = np.unique(pdf.e, return_inverse=True)
        gs, g = np.unique(pdf.g, return_inverse=True)
        cost = -pdf.score.to_numpy() if larger else pdf.score.to_numpy()
        low = cost.min()
        pad = (cost.max() - low) * (min(len(es), len(gs)) + 1) + 1
        full = np.full((len(es), len(gs)), pad)
        full[e, g] = cost - low
        flip = len(es) > len(gs)
        cols = solve(full.T if flip else full)
        rows = np.arange(len(cols))
        a, b = (cols, rows) if flip else (rows, cols)
        ok = full[a, b] < pad
        a, b = a[ok], b[ok]
        value = full[a, b] + low
        return type(pdf)({**{k: pdf[k].iloc[0] for k in key}, "e": es[a], "g": gs[b], "score": -value if larger else value})

    rows = pairs.select(*key, "e", "g", "score")
    return rows.groupBy(*key).applyInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


def assign(pairs: DataFrame, m: Matcher, key: list[str] | None = None) -> DataFrame:
    return (assign_greedy if m.assignment == "greedy" else assign_optimal)(pairs, m.better, key)


def matched(est: DataFrame, gt: DataFrame, m: Matcher, cuts: tuple | None = None) -> DataFrame:
    """(frame, e, g, score) of the pairs that are matched; with ``cuts`` at each of these thresholds (column ``cut``)."""
    if m.assignment == "greedy" and not callable(m.score) and m.score in KINDS:
        return assign_in_turn(est, gt, m, cuts)
    pairs = feasible(est, gt, m)
    if not cuts:
        return assign(pairs, m)
    met = F.filter(F.array(*(F.lit(float(t)) for t in cuts)), lambda t: F.col("score") >= t if m.better else F.col("score") <= t)
    return assign(pairs.withColumn("cut", F.explode(met)), m, [*frame_key(est, gt), "cut"])


def verdicts(est: DataFrame, gt: DataFrame, got: DataFrame, m: Matcher, extra: tuple = ()) -> DataFrame:
    """Every row of both sides once, with the columns of both (e_, g_), given the pairs ``got(e, g, score)``."""
    key = [*frame_key(est, gt), *extra]
    e, g = side(est, "e_", key), side(gt, "g_", key)
    found = e.join(got.withColumnRenamed("e", "e_row_idx"), [*key, "e_row_idx"], "left").join(g.withColumn("g", F.col("g_row_idx")), [*key, "g"], "full")
    est_index, gt_index = F.coalesce("e_row_idx", F.lit(-1)), F.coalesce("g_row_idx", F.lit(-1))
    status = F.when(F.col("e_row_idx").isNull(), FN).when(F.col("g_row_idx").isNull(), FP).otherwise(TP)
    limit = m.threshold_of(F.coalesce("g_class", "e_class"))
    hit = (status == TP) & (F.col("e_class") == F.col("g_class"))
    return found.select(*key, est_index.alias("est_index"), gt_index.alias("gt_index"), "score", status.alias("status"), limit.alias("threshold"), F.coalesce(hit, F.lit(False)).alias("label_correct"), *(c for c in e.columns + g.columns if c not in key))


def evaluate(est: DataFrame, gt: DataFrame, m: Matcher = Matcher()) -> DataFrame:
    """:func:`match` and :func:`match_join` in one plan: verdicts with the columns of both sides."""
    return verdicts(est, gt, matched(est, gt, m), m)


def match(est: DataFrame, gt: DataFrame, m: Matcher = Matcher()) -> DataFrame:
    """(frame, est_index, gt_index, score, status, threshold): every row of both sides once.

    Unmatched sides have index -1 and no score.  Threshold: the ground truth's class's, for a lone
    estimate its own class's.  Tables of several recordings have a column ``recording``.
    """
    return evaluate(est, gt, m).select(*frame_key(est, gt), "est_index", "gt_index", "score", "status", "threshold")


def match_join(matches: DataFrame, est: DataFrame, gt: DataFrame) -> DataFrame:
    """Stored verdicts with the columns of both sides, prefixed e_ and g_; an index without a row raises."""
    key = frame_key(matches, est, gt)
    e, g = side(est, "e_", key).withColumn("est_index", F.col("e_row_idx")), side(gt, "g_", key).withColumn("gt_index", F.col("g_row_idx"))
    out = matches.join(e, [*key, "est_index"], "left").join(g, [*key, "gt_index"], "left")
    lost = ((F.col("est_index") >= 0) & F.col("e_row_idx").isNull()) | ((F.col("gt_index") >= 0) & F.col("g_row_idx").isNull())
    out = out.withColumn("status", F.when(lost, F.raise_error(F.lit("a match points to no row")).cast("int")).otherwise(F.col("status")))
    return out.withColumn("label_correct", F.coalesce((F.col("status") == TP) & (F.col("e_class") == F.col("g_class")), F.lit(False)))


def counts(matches: DataFrame) -> DataFrame:
    """(tp, fp, fn) of verdicts."""
    return matches.agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in ((TP, "tp"), (FP, "fp"), (FN, "fn"))))
