"""Time: ranges, latest values, as-of joins, pairing of two time axes, and coordinate frames."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import pose as P
from sightline.functions.keys import frame_key


def time_range(rows: DataFrame, low: int | None = None, high: int | None = None, open_low: bool = False, open_high: bool = False, column: str = "frame") -> DataFrame:
    t = F.col(column)
    if low is not None:
        rows = rows.where(t > low if open_low else t >= low)
    if high is not None:
        rows = rows.where(t < high if open_high else t <= high)
    return rows


def latest_at(rows: DataFrame, at: int, column: str = "frame") -> DataFrame:
    """All rows of the newest time up to ``at``, of each recording its own.

    Of several writes at that time (``chunk_seq``) the last one counts.
    """
    by = [c for c in ("recording",) if c in rows.columns]
    order = [column, *(c for c in ("chunk_seq",) if c in rows.columns)]
    newest = rows.where(F.col(column) <= at).groupBy(*by).agg(F.max(F.struct(*order)).alias("_last"))
    newest = newest.select(*by, *(F.col(f"_last.{c}").alias(c) for c in order))
    return rows.join(F.broadcast(newest) if not by else newest, [*by, *order], "left_semi")


def times(rows: DataFrame, column: str = "frame") -> DataFrame:
    """The distinct times, sorted."""
    return rows.select(column).distinct().orderBy(column)


def _bracket(probes: DataFrame, samples: DataFrame, by: list[str]) -> DataFrame:
    """Probes with the samples before (or at) and after (or at) them.

    Only the distinct times of probes are sorted together with the samples, one axis (``by``) in one
    window; what they find is joined back.  An axis is one recording's frames.
    """
    names = [c for c in samples.columns if c not in ("t", *by)]
    whole = F.struct("t", *names)
    ticks = probes.select(*by, "t").where("t IS NOT NULL").distinct()
    both = ticks.withColumn("_s", F.lit(None).cast(samples.select(whole.alias("s")).schema["s"].dataType)).unionByName(samples.select(*by, "t", whole.alias("_s")))
    order = Window.partitionBy(*by).orderBy("t", F.col("_s").isNull())
    back = Window.partitionBy(*by).orderBy(F.desc("t"), F.col("_s").isNull())  # backwards: frames that end unbounded take quadratic time
    both = both.withColumn("low", F.last("_s", True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("high", F.last("_s", True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    found = both.where("_s IS NULL").select(*(F.col(c).alias(f"_{c}") for c in by), F.col("t").alias("_t"), "low", "high")
    same = F.col("t") == F.col("_t")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return probes.join(found, same, "left").drop("_t", *(f"_{c}" for c in by))


def as_of(probes: DataFrame, samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each probe with the newest sample up to its time ``t``, as struct ``sample`` (null: none)."""
    return _bracket(probes, samples, by or []).withColumnRenamed("low", "sample").drop("high")


def lookup(probes: DataFrame, edges: DataFrame, policy: str = "latest", by: list[str] | None = None) -> DataFrame:
    """Each probe with the ``pose`` of an edge at its time.

    latest: the newest up to then; exact: of that time only; nearest: the closer one, the earlier of
    two; interpolate: between the two around it, the end's beyond the ends.
    """
    got = _bracket(probes, edges.select(*(by or []), "t", *P.PARTS), by or [])
    low, high, t = F.col("low"), F.col("high"), F.col("t")
    strip = lambda s: P.pose(*(s[k] for k in P.PARTS))
    if policy == "latest":
        value = F.when(low.isNotNull(), strip(low))
    elif policy == "exact":
        value = F.when(low["t"] == t, strip(low))
    elif policy == "nearest":
        value = F.when(high.isNull() | (t - low["t"] <= high["t"] - t), strip(low)).otherwise(F.when(high.isNotNull(), strip(high)))
    elif policy == "interpolate":
        share = (t - low["t"]) / (high["t"] - low["t"])
        value = F.when(low.isNull(), strip(high)).when(high.isNull() | (low["t"] == high["t"]), strip(low)).otherwise(P.interpolate(low, high, share))
    else:
        raise ValueError(policy)
    return got.withColumn("pose", value).drop("low", "high")


def frame_path(edges: list[tuple[str, str]], source: str, target: str) -> list[tuple[str, str, bool]]:
    """Fewest (parent, child, inverted) hops that bring points from ``source`` into ``target``."""
    if len(set(edges)) != len(edges):
        raise ValueError("an edge is given twice")
    near: dict[str, list] = {}
    for parent, child in edges:
        near.setdefault(child, []).append((parent, (parent, child, False)))
        near.setdefault(parent, []).append((child, (parent, child, True)))
    if source not in near or target not in near:
        raise KeyError("unknown frame")
    came: dict[str, tuple | None] = {source: None}
    todo = deque([source])
    while todo and target not in came:
        at = todo.popleft()
        for nxt, hop in near[at]:
            if nxt not in came:
                came[nxt] = (at, hop)
                todo.append(nxt)
    if target not in came:
        raise KeyError("the frames are not connected")
    hops = []
    while came[target]:
        target, hop = came[target]
        hops.append(hop)
    return hops[::-1]


@dataclass(frozen=True)
class FrameGraph:
    """Coordinate frames and the edges (parent, child) between them; ``static`` ones have no time."""

    edges: dict[tuple[str, str], bool]

    @staticmethod
    def of(edges: DataFrame) -> FrameGraph:
        """From ``edges(t, parent, child, ...)``; a null ``t`` is static.

        An edge without a parent raises, and so does one that is both static and recorded over time.
        Only the distinct edges come to the driver: a robot has tens of frames.
        """
        found: dict[tuple[str, str], bool] = {}
        for r in edges.select("parent", "child", F.col("t").isNull().alias("static")).distinct().collect():
            if r.parent is None:
                raise ValueError(f"the edge to {r.child} has no parent")
            if (r.parent, r.child) in found:
                raise ValueError(f"{r.parent} -> {r.child} is recorded twice")
            found[r.parent, r.child] = r.static
        return FrameGraph(found)

    @property
    def frames(self) -> set[str]:
        return {f for e in self.edges for f in e}

    def path(self, source: str, target: str) -> list[tuple[str, str, bool]]:
        return frame_path(list(self.edges), source, target)


class Resolver:
    """Poses between any two frames of ``edges(t, parent, child, tx .. qw)`` at the times of rows.

    Each hop over time is one as-of join by ``policy``, a static hop one row; of several static
    writes the last one counts (``seq``), and without ``seq`` different ones raise.  With ``strict``
    a row for which a hop has no pose raises.
    """

    def __init__(self, edges: DataFrame, policy: str = "latest", by: list[str] | None = None, strict: bool = True):
        self.edges, self.policy, self.by, self.strict = edges, policy, by or [], strict
        self.graph = FrameGraph.of(edges)

    def _static(self, parent: str, child: str) -> DataFrame:
        rows = self.edges.where((F.col("parent") == parent) & (F.col("child") == child) & F.col("t").isNull())
        whole = F.struct(*P.PARTS)
        if "seq" in self.edges.columns:
            return rows.agg(F.max_by(whole, "seq").alias("_hop"))
        spread = F.greatest(*(F.max(c) - F.min(c) for c in P.PARTS))
        one = F.when(spread > 1e-9, F.raise_error(F.lit(f"{parent} -> {child} has different static poses")).cast(rows.select(whole.alias("s")).schema["s"].dataType)).otherwise(F.first(whole))
        return rows.agg(one.alias("_hop"))

    def lookup(self, rows: DataFrame, target: str, source: str) -> DataFrame:
        """``rows`` with ``pose``: where ``source`` lies in ``target`` at the row's time ``t``."""
        rows = rows.withColumn("pose", P.identity())
        for parent, child, inverted in self.graph.path(source, target):
            if self.graph.edges[parent, child]:
                rows = rows.crossJoin(F.broadcast(self._static(parent, child)))
            else:
                if "t" not in rows.columns:
                    raise ValueError(f"{parent} -> {child} is recorded over time: rows need a time")
                samples = self.edges.where((F.col("parent") == parent) & (F.col("child") == child) & F.col("t").isNotNull())
                rows = lookup(rows.withColumnRenamed("pose", "_sofar"), samples, self.policy, self.by).withColumnsRenamed({"pose": "_hop", "_sofar": "pose"})
            if self.strict:
                kind = rows.schema["_hop"].dataType
                rows = rows.withColumn("_hop", F.coalesce("_hop", F.raise_error(F.concat(F.lit(f"no pose of {parent} -> {child} at "), F.coalesce(F.col("t").cast("string"), F.lit("no time")) if "t" in rows.columns else F.lit("any time"))).cast(kind)))
            hop = P.invert(F.col("_hop")) if inverted else F.col("_hop")
            rows = rows.withColumn("pose", P.compose(hop, F.col("pose"))).drop("_hop")
        return rows


#: How columns move: points turn and shift, directions turn; ``mask`` holds in the old frame only.
POINT, DIRECTION, ROTATION, STEPS, DROP = "point", "direction", "rotation", "steps", "drop"
KINDS: list[tuple[str, tuple[str, ...]]] = [
    (POINT, ("x", "y", "z")),
    (DIRECTION, ("vx", "vy", "vz")),
    (ROTATION, ("qx", "qy", "qz", "qw")),
    (ROTATION, ("yaw",)),
    (STEPS, ("future",)),
    (STEPS, ("modes",)),
    (DROP, ("mask",)),
]


def _steps(column: Column, kind, p: Column) -> Column:
    """Waypoints (an array of structs with x, y and perhaps z, or of modes that hold such) moved by ``p``."""
    fields = kind.elementType.names

    def one(s: Column) -> Column:
        if "x" not in fields:
            return F.struct(*(_steps(s[c], kind.elementType[c].dataType, p).alias(c) if c == "steps" else s[c].alias(c) for c in fields))
        at = dict(zip("xyz", P.apply_point(p, s["x"], s["y"], s["z"] if "z" in fields else F.lit(0.0))))
        return F.struct(*(at.get(c, s[c]).alias(c) for c in fields))

    return F.transform(column, one)


def transform(rows: DataFrame, invert: bool = False, kinds: list | None = None) -> DataFrame:
    """Move a table's geometry by its column ``pose``, which goes; ``KINDS`` says how columns move."""
    p, kinds = F.col("_p"), KINDS if kinds is None else kinds
    rows = rows.withColumn("_p", P.invert(F.col("pose")) if invert else F.col("pose"))
    there, moved, gone = set(rows.columns), {}, []
    for kind, names in kinds:
        if not set(names) <= there:
            continue
        if kind == POINT:
            moved |= dict(zip(names, P.apply_point(p, *(F.col(k) for k in names))))
        elif kind == DIRECTION:
            moved |= dict(zip(names, P.rotate(p, *(F.col(k) for k in names))))
        elif kind == ROTATION:
            own = F.struct(*(F.col(k).alias(f"q{c}") for k, c in zip(names, "xyzw"))) if len(names) == 4 else None
            if own is None:  # a yaw goes with the quaternion beside it, where there is one
                half = F.col(names[0]) / 2
                q = {f"q{c}" for c in "xyzw"} <= there
                own = F.struct(*(F.col(f"q{c}") for c in "xyzw")) if q else F.struct(F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"), F.cos(half).alias("qw"))
            turned = P.multiply(p, own)
            moved |= dict(zip(names, turned)) if len(names) == 4 else {names[0]: P.yaw(*turned)}
        elif kind == STEPS:
            moved[names[0]] = _steps(F.col(names[0]), rows.schema[names[0]].dataType, p)
        elif kind == DROP:
            gone += names
    return rows.withColumns(moved).drop("_p", "pose", *gone)


def in_frame(rows: DataFrame, target: str, resolver: Resolver | None = None, time: str = "frame") -> DataFrame:
    """``rows`` in the coordinate frame ``target``, each moved by the pose at its own time.

    Their own frame is what their column ``frame_id`` states, one for the table; none raises.
    """
    stated = [r[0] for r in rows.select("frame_id").where("frame_id IS NOT NULL").distinct().limit(2).collect()] if "frame_id" in rows.columns else []
    if len(stated) != 1:
        raise ValueError("the rows state no coordinate frame" if not stated else f"the rows state several coordinate frames: {stated}")
    if stated[0] == target:
        return rows.drop("mask")
    if resolver is None:
        raise ValueError(f"{stated[0]} -> {target} needs a resolver")
    keep = [c for c in rows.columns if c != "mask"]
    found = resolver.lookup(rows.withColumn("t", F.col(time)), target, stated[0])
    return transform(found).withColumn("frame_id", F.lit(target)).select(*keep)


def pair_times(reference: DataFrame, query: DataFrame, tolerance: int, offset: int = 0, by: list[str] | None = None) -> DataFrame:
    """(reference, query): one-to-one pairs of times, the closest first, then the earlier ones.

    Candidates are the two neighbours on either side within ``tolerance``.  Times are one row a frame
    of a recording (``by``); the greedy choice goes over the candidates of one recording in order.
    """
    by = by or []
    q = query.select(*by, (F.col("t") + offset).alias("t"), F.col("t").alias("own")).distinct()
    r = reference.select(*by, "t", F.col("t").alias("own")).distinct()
    pick = lambda a, b, x, y: _bracket(a, b, by).select(*by, F.col("own").alias(x), F.explode(F.array_compact(F.array("low.own", "high.own"))).alias(y))
    cand = pick(r, q, "r", "q").unionByName(pick(q, r, "q", "r")).distinct()
    cand = cand.withColumn("d", F.abs(F.col("q") + offset - F.col("r"))).where(F.col("d") <= tolerance)

    def choose(pdf):
        seen_r, seen_q, rows = set(), set(), []
        for i, (a, b) in enumerate(zip((pdf := pdf.sort_values(["d", "r", "q"])).r, pdf.q)):
            if a not in seen_r and b not in seen_q:
                seen_r.add(a)
                seen_q.add(b)
                rows.append(i)
        return pdf.iloc[rows][[*by, "r", "q"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cand.select(*by, "r", "q").schema)
    return cand.groupBy(*by).applyInPandas(choose, schema).withColumnsRenamed({"r": "reference", "q": "query"})


def reindex(rows: DataFrame, pairs: DataFrame, column: str = "frame") -> DataFrame:
    """Rows of paired times only, at their reference times."""
    return rows.join(pairs.select(F.col("query").alias(column), "reference"), column).withColumn(column, F.col("reference")).drop("reference")


def align_points(est: DataFrame, gt: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Estimates in the order of the ground truth points they lie on (row_idx of ``gt``).

    A ground truth point without an estimate raises, and so does an estimate that two share.
    """
    key = frame_key(est, gt)
    size = max(tolerance, 1e-9)
    cell = lambda p: [F.floor(F.col(p + k) / size).cast("long").alias(f"c{k}") for k in "xyz"]
    g = gt.select(*key, F.col("row_idx").alias("g"), *(F.col(k).alias(f"g{k}") for k in "xyz"))
    offsets = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1))))
    near = g.select("*", *cell("g")).withColumn("o", offsets).select(*key, "g", "gx", "gy", "gz", *((F.col(f"c{k}") + F.col(f"o.{a}")).alias(f"c{k}") for k, a in zip("xyz", "abc")))
    d = F.sqrt((F.col("x") - F.col("gx")) ** 2 + (F.col("y") - F.col("gy")) ** 2 + (F.col("z") - F.col("gz")) ** 2)
    cols = [c for c in est.columns if c not in key]
    pairs = near.join(est.select(*key, *cols, *cell("")), [*key, "cx", "cy", "cz"]).withColumn("d", d).where(F.col("d") <= tolerance)
    best = pairs.groupBy(*key, "g").agg(F.min_by(F.struct(*cols), F.struct("d", "row_idx")).alias("e"))
    shared = F.count("*").over(Window.partitionBy(*key, "e.row_idx"))
    best = best.withColumn("shared", shared)
    out = g.select(*key, "g").join(best, [*key, "g"], "left")
    ok = F.when(F.col("e").isNull(), F.raise_error(F.lit("a ground truth point has no estimate")).cast("long")).when(F.col("shared") > 1, F.raise_error(F.lit("two ground truth points share an estimate")).cast("long")).otherwise(F.col("g"))
    return out.select(*key, *(F.col(f"e.{c}").alias(c) for c in cols if c != "row_idx"), ok.alias("row_idx"))


def frame_times(rows: DataFrame, time: str = "t") -> DataFrame:
    """(frame, t); a frame recorded at two times raises."""
    key = frame_key(rows)
    got = rows.groupBy(*key).agg(F.min(time).alias("t"), F.max(time).alias("_high"))
    return got.select(*key, F.when(F.col("t") == F.col("_high"), F.col("t")).otherwise(F.raise_error(F.concat(F.lit("two times of frame "), F.col("frame").cast("string"))).cast(got.schema["t"].dataType)).alias("t"))
