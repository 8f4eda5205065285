"""Queries over the general tables, one for each operator, with SQL that says the same."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import geometry as G
from sightline.functions import pose as P
from sightline.functions.labels import LabelRegistry, intern
from sightline.operators import filters as L
from sightline.operators import metrics as M
from sightline.operators import prediction as D
from sightline.operators import timeline as T
from sightline.operators.matching import Matcher, evaluate, match, match_join, scored, sides
from sightline.plans import assembly as A
from sightline.plans.pipeline import Catalog, Pipeline, average_precision_sweep
from sightline.plans.store import Store, concat, narrow
from sightline.sources import tables as S
from sightline.sources.recording import read_recording, write_recording
from sightline.sources.scratch import Scratch, stored

CLASSES = ["click", "error", "purchase", "signup", "view"]
POLYGON = [(5.0, 1.0), (45.0, 0.0), (50.0, 8.0), (20.0, 10.0)]

GEN = """
hours AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS frame, event_id, value AS x, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS DOUBLE) AS y,
  event_type AS class, user_id AS instance, (event_id * 7919 % 1000) / 1000.0 AS confidence FROM events),
te AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY event_id) - 1 AS row_idx FROM hours WHERE event_id % 2 = 1),
tg AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY event_id) - 1 AS row_idx FROM hours WHERE event_id % 2 = 0)"""
BOX = """
raw AS (SELECT date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS frame, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, (2 * 3.141592653589793) * (l_partkey % 360) / 360 AS yaw,
  l_quantity / 10 + 1 AS w, l_quantity / 5 + 2 AS l, CAST(2 AS DOUBLE) AS h, l_returnflag AS class, l_suppkey AS instance,
  least(CAST(1 AS DOUBLE), l_extendedprice / 110000) AS confidence, l_partkey % 500 AS rx, l_suppkey % 500 AS ry,
  CAST(l_quantity + 20 AS INT) AS rh, l_linenumber * 5 + 20 AS rw, CAST(l_quantity AS INT) AS num_points, l_linenumber % 5 - 1 AS visibility FROM lineitem),
be AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS row_idx FROM raw WHERE l_linenumber % 2 = 0),
bg AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS row_idx FROM raw WHERE l_linenumber % 2 = 1)"""


POSES = "po AS (SELECT t, max_by(o_totalprice, (o_totalprice, o_orderkey, o_custkey)) / 1000 AS tx, CAST(max_by(o_orderkey, (o_totalprice, o_orderkey, o_custkey)) % 100 AS DOUBLE) AS ty, (2 * 3.141592653589793) * (max_by(o_custkey, (o_totalprice, o_orderkey, o_custkey)) % 360) / 360 AS yaw FROM (SELECT *, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS t FROM orders) GROUP BY t)"


def picks(pairs: str) -> str:
    """Greedy assignment as a recursion over each frame's feasible pairs."""
    return f"""
pr AS ({pairs}),
od AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY confidence DESC, e DESC, score, g) AS k FROM pr),
st AS (SELECT DISTINCT frame, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS es, CAST([] AS BIGINT[]) AS gs, CAST([] AS DOUBLE[]) AS ss FROM od
  UNION ALL SELECT st.frame, st.k + 1,
    CASE WHEN list_contains(es, e) OR list_contains(gs, g) THEN es ELSE list_append(es, e) END,
    CASE WHEN list_contains(es, e) OR list_contains(gs, g) THEN gs ELSE list_append(gs, g) END,
    CASE WHEN list_contains(es, e) OR list_contains(gs, g) THEN ss ELSE list_append(ss, score) END
  FROM st JOIN od ON od.frame = st.frame AND od.k = st.k + 1),
en AS (SELECT frame, es, gs, ss FROM st QUALIFY row_number() OVER (PARTITION BY frame ORDER BY k DESC) = 1),
mt AS (SELECT frame, unnest(es) AS e, unnest(gs) AS g, unnest(ss) AS score FROM en)"""


def joined(pairs: str, e: str = "te", g: str = "tg") -> str:
    return f"WITH RECURSIVE {GEN if e == 'te' else BOX}, {picks(pairs)}, jn AS (SELECT coalesce(me.frame, {g}.frame) AS frame, me.row_idx AS est_index, {g}.row_idx AS gt_index, score, CASE WHEN me.row_idx IS NULL THEN 2 WHEN score IS NULL THEN 1 ELSE 0 END AS status, me.class AS ec, {g}.class AS gc, me.instance AS ei, {g}.instance AS gi, me.confidence AS c FROM (SELECT {e}.*, mt.g, mt.score FROM {e} LEFT JOIN mt ON mt.frame = {e}.frame AND mt.e = {e}.row_idx) me FULL JOIN {g} ON {g}.frame = me.frame AND {g}.row_idx = me.g)"


def track_pairs(limit: str, same: str = "te.class = tg.class") -> str:
    d = "sqrt((te.x - tg.x) * (te.x - tg.x) + (te.y - tg.y) * (te.y - tg.y))"
    return f"SELECT te.frame, te.row_idx AS e, tg.row_idx AS g, te.confidence, {d} AS score FROM te JOIN tg ON te.frame = tg.frame WHERE {same} AND {d} <= {limit}"


def corner(b, k):
    """SQL of a footprint corner, front left first, counter-clockwise."""
    along, across = ((1, 1), (-1, 1), (-1, -1), (1, -1))[k % 4]
    u, v = f"{along} * {b}.l / 2", f"{across} * {b}.w / 2"
    return f"({b}.x + {u} * cos({b}.yaw) - {v} * sin({b}.yaw))", f"({b}.y + {u} * sin({b}.yaw) + {v} * cos({b}.yaw))"


def _footprint(b):
    return "[" + ", ".join("{{'x': {0}, 'y': {1}}}".format(*corner(b, k)) for k in range(4)) + "]"


#: Common areas by Green's theorem: the parts of either outline inside the other; an edge that both share counts once.
CLIPPED = f"""WITH {BOX},
pr AS (SELECT be.frame, be.row_idx AS e, bg.row_idx AS g, {_footprint('be')} AS pa, {_footprint('bg')} AS pb, be.w AS wa, be.l AS la, be.h AS ha, bg.w AS wb, bg.l AS lb, bg.h AS hb,
  greatest(0.0, least(be.z + be.h / 2, bg.z + bg.h / 2) - greatest(be.z - be.h / 2, bg.z - bg.h / 2)) AS tall FROM be JOIN bg ON be.frame = bg.frame AND be.class = bg.class),
ed AS (SELECT frame, e, g, side, i, CASE WHEN side = 0 THEN pa ELSE pb END AS own, CASE WHEN side = 0 THEN pb ELSE pa END AS other FROM pr CROSS JOIN (SELECT unnest([0, 1]) AS side) CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i)),
pt AS (SELECT frame, e, g, side, i, j, own[i + 1].x AS ax, own[i + 1].y AS ay, own[(i + 1) % 4 + 1].x AS bx, own[(i + 1) % 4 + 1].y AS by_, other[j + 1].x AS px, other[j + 1].y AS py, other[(j + 1) % 4 + 1].x AS qx, other[(j + 1) % 4 + 1].y AS qy FROM ed CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS j)),
sd AS (SELECT *, (qx - px) * (ay - py) - (qy - py) * (ax - px) AS r0, (qx - px) * (by_ - py) - (qy - py) * (bx - px) AS r1, (qx - px) * (bx - ax) + (qy - py) * (by_ - ay) AS along FROM pt),
st AS (SELECT *, CASE WHEN abs(r0) < 1e-9 THEN 0 ELSE r0 END AS s0, CASE WHEN abs(r1) < 1e-9 THEN 0 ELSE r1 END AS s1 FROM sd),
cu AS (SELECT frame, e, g, side, i, any_value(ax) AS ax, any_value(ay) AS ay, any_value(bx) AS bx, any_value(by_) AS by_,
  bool_or((s0 < 0 AND s1 <= 0) OR (s0 <= 0 AND s1 < 0) OR (s0 = 0 AND s1 = 0 AND (side = 1 OR along < 0))) AS outside,
  greatest(0.0, max(CASE WHEN s0 < 0 AND s1 > 0 THEN s0 / (s0 - s1) ELSE 0 END)) AS t0, least(1.0, min(CASE WHEN s0 > 0 AND s1 < 0 THEN s0 / (s0 - s1) ELSE 1 END)) AS t1 FROM st GROUP BY frame, e, g, side, i),
gr AS (SELECT frame, e, g, sum(CASE WHEN outside OR t0 >= t1 THEN 0 ELSE ((ax + t0 * (bx - ax)) * (ay + t1 * (by_ - ay)) - (ay + t0 * (by_ - ay)) * (ax + t1 * (bx - ax))) / 2 END) AS inter FROM cu GROUP BY frame, e, g),
ar AS (SELECT pr.*, greatest(gr.inter, 0) AS inter FROM pr JOIN gr USING (frame, e, g))"""


def _ring(b):
    return "list_sort([" + ", ".join("{{'t': atan2({1} - {2}.y, {0} - {2}.x), 'i': {3}, 'x': {0}, 'y': {1}}}".format(*corner(b, k), b, k) for k in range(4)) + "])"


def _apart(i, k):
    p, q = f"ca[{(i + k) % 4 + 1}]", f"cb[{i + 1}]"
    return f"sqrt(({p}.x - {q}.x) * ({p}.x - {q}.x) + ({p}.y - {q}.y) * ({p}.y - {q}.y))"


def _face(n):
    p, q = f"ca[(nr[{n}].i + k) % 4 + 1]", f"cb[nr[{n}].i + 1]"
    return f"(({p}.x - {q}.x) * ({p}.x - {q}.x) + ({p}.y - {q}.y) * ({p}.y - {q}.y))"


PLANE = f"""WITH {BOX},
pr AS (SELECT be.frame, be.row_idx AS e, bg.row_idx AS g, {_ring('be')} AS ca, {_ring('bg')} AS cb FROM be JOIN bg ON be.frame = bg.frame AND be.class = bg.class),
sh AS (SELECT *, list_sort([{", ".join("{'s': " + " + ".join(_apart(i, k) for i in range(4)) + f", 'k': {k}" + "}" for k in range(4))}])[1].k AS k,
  list_sort([{", ".join("{'d': sqrt(" + f"cb[{i + 1}].x * cb[{i + 1}].x + cb[{i + 1}].y * cb[{i + 1}].y" + f"), 'i': {i}" + "}" for i in range(4))}]) AS nr FROM pr)
SELECT frame, e, g, round(sqrt(({_face(1)} + {_face(2)}) / 2), 6) AS score FROM sh"""

BY_CLASS = {"click": 10.0, "view": 40.0}


def verdicts(spark, d, m: Matcher) -> DataFrame:
    return match(S.tracks(spark, d, "est"), S.tracks(spark, d, "gt"), m)


def verdict_rows(spark, d, m: Matcher) -> DataFrame:
    return neat(verdicts(spark, d, m).drop("threshold"))


GREEDY = Matcher("bev_distance", 20.0, assignment="greedy")


def hits(spark, d, m: Matcher = GREEDY) -> DataFrame:
    """Verdicts with the columns of both sides, written once: metrics read them more than once."""
    return stored(evaluate(S.tracks(spark, d, "est"), S.tracks(spark, d, "gt"), m), "verdicts")


def neat(rows: DataFrame) -> DataFrame:
    """Rounded doubles, undefined as null."""
    out = []
    for f in rows.schema.fields:
        c = F.col(f.name)
        out.append(F.when(~F.isnan(c), F.round(c, 6)).alias(f.name) if f.dataType.simpleString() == "double" else c)
    return rows.select(*out)


def kept(rows: DataFrame, predicate) -> DataFrame:
    return L.masked(rows, L.mask(rows, predicate)).select("frame", "row_idx")


VERDICT = "SELECT frame, coalesce(est_index, -1) AS est_index, coalesce(gt_index, -1) AS gt_index, round(score, 6) AS score, status FROM jn"
_Q: dict = {}
_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _filters() -> None:
    box = lambda where: f"WITH {BOX} SELECT frame, row_idx FROM be WHERE {where}"
    half = " AND ".join(f"(({x2} - {x1}) * (y - {y1}) - ({y2} - {y1}) * (x - {x1})) >= 0" for (x1, y1), (x2, y2) in zip(POLYGON, POLYGON[1:] + POLYGON[:1]))
    turn = "(atan2(y, x) - 0.1 - 6.283185307179586 * floor((atan2(y, x) - 0.1) / 6.283185307179586))"
    for name, predicate, where in (
        ("filter_distance", lambda: L.by_distance(5, 30), "sqrt(x * x + y * y + z * z) BETWEEN 5 AND 30"),
        ("filter_distance_bev", lambda: L.by_distance(5, 30, True), "sqrt(x * x + y * y) BETWEEN 5 AND 30"),
        ("filter_region_box", lambda: L.by_region((5, 2), (30, 6)), "x BETWEEN 5 AND 30 AND y BETWEEN 2 AND 6"),
        ("filter_region_polygon", lambda: L.by_region(polygon=POLYGON), half),
        ("filter_map", lambda: L.by_map([POLYGON]), half.replace(">=", ">")),
        ("filter_polar_grid", lambda: L.by_polar_grid(3, 40, 0.1, 0.6), f"sqrt(x * x + y * y) BETWEEN 3 AND 40 AND {turn} <= 0.5 + 1e-9"),
        ("filter_label", lambda: L.by_label(["A", "N"], ["N"]), "class = 'A'"),
        ("filter_instance", lambda: L.by_instance(exclude=[1, 2, 3]), "instance NOT IN (1, 2, 3)"),
        ("filter_confidence", lambda: L.by_confidence(0.2, 0.7), "confidence BETWEEN 0.2 AND 0.7"),
        ("filter_num_points", lambda: L.by_num_points(5, 20), "num_points BETWEEN 5 AND 20"),
        ("filter_visibility", lambda: L.by_visibility(2), "visibility = -1 OR visibility >= 2"),
    ):
        query(name, box(where))(lambda s, d, p=predicate: kept(S.boxes(s, d, "est"), p()))


def _masks() -> None:
    near, sure = "sqrt(x * x + y * y + z * z) BETWEEN 0 AND 25", "confidence BETWEEN 0.5 AND 1"

    def both(s, d, mode):
        rows = S.boxes(s, d, "est")
        return L.combine([L.mask(rows, L.by_distance(0, 25)), L.mask(rows, L.by_confidence(0.5, 1))], mode)

    query("combine_masks_all", f"WITH {BOX} SELECT frame, row_idx, ({near}) AND ({sure}) AS mask FROM be")(lambda s, d: both(s, d, "all"))
    query("combine_masks_any", f"WITH {BOX} SELECT frame, row_idx, ({near}) OR ({sure}) AS mask FROM be")(lambda s, d: both(s, d, "any"))
    query("apply_mask", f"WITH {BOX} SELECT frame, class, row_number() OVER (PARTITION BY frame ORDER BY row_idx) - 1 AS row_idx FROM be WHERE ({near}) OR ({sure})")(
        lambda s, d: L.apply(S.boxes(s, d, "est"), both(s, d, "any")).select("frame", "class", "row_idx")
    )
    pts = "SELECT vec_id % 10 AS frame, vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings"

    def coverage(s, d):
        rows = S.points(s, d).withColumn("row_idx", F.col("point_id"))
        return L.by_coverage(rows, rows.where("point_id % 3 = 0"), 0.05)

    query("filter_points_coverage", f"WITH p AS ({pts}) SELECT frame, point_id AS row_idx, EXISTS (SELECT 1 FROM p q WHERE q.frame = p.frame AND q.point_id % 3 = 0 AND sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) <= 0.05) AS mask FROM p")(coverage)
    query("filter_points_distance", f"WITH p AS ({pts}) SELECT frame, point_id FROM p WHERE sqrt(x * x + y * y + z * z) BETWEEN 0.1 AND 0.3")(lambda s, d: S.points(s, d).where(L.by_distance(0.1, 0.3)).select("frame", "point_id"))

    def aligned(s, d):
        gt = S.points(s, d).withColumn("row_idx", F.col("point_id"))
        est = gt.select("frame", "x", "y", "z", F.col("class"), (999999 - F.col("point_id")).alias("row_idx"))
        return T.align_points(est, gt).select("frame", "row_idx", "class")

    query("align_points", "SELECT vec_id % 10 AS frame, vec_id AS row_idx, label AS class FROM embeddings")(aligned)


def _scores() -> None:
    def score(f, s, d):
        rows = sides(S.boxes(s, d, "est"), S.boxes(s, d, "gt")).where("e_class = g_class")
        return neat(rows.select("frame", F.col("e_row_idx").alias("e"), F.col("g_row_idx").alias("g"), f("e_", "g_").alias("score")))

    def by_kernel(name, s, d):
        return neat(scored(S.boxes(s, d, "est"), S.boxes(s, d, "gt"), name))

    def sql(expr):
        return f"WITH {BOX} SELECT be.frame, be.row_idx AS e, bg.row_idx AS g, round({expr}, 6) AS score FROM be JOIN bg ON be.frame = bg.frame AND be.class = bg.class"

    dx = "+".join(f"(be.{k} - bg.{k}) * (be.{k} - bg.{k})" for k in "xyz")
    over = lambda a, n: f"greatest(0.0, least(be.{a} + be.{n}, bg.{a} + bg.{n}) - greatest(be.{a}, bg.{a}))"
    inter = f"({over('rx', 'rw')} * {over('ry', 'rh')})"
    high = "greatest(0.0, least(be.z + be.h / 2, bg.z + bg.h / 2) - greatest(be.z - be.h / 2, bg.z - bg.h / 2))"
    query("score_center_distance", sql(f"sqrt({dx})"))(lambda s, d: score(G.center_distance, s, d))
    query("score_center_distance_bev", sql("sqrt((be.x - bg.x) * (be.x - bg.x) + (be.y - bg.y) * (be.y - bg.y))"))(lambda s, d: score(G.bev_distance, s, d))
    query("score_height_overlap", sql(high))(lambda s, d: score(G.height_overlap, s, d))
    query("score_iou_roi", sql(f"{inter} / (be.rw * be.rh + bg.rw * bg.rh - {inter})"))(lambda s, d: score(G.roi_iou, s, d))
    area, volume = "ar.wa * ar.la + ar.wb * ar.lb", "ar.wa * ar.la * ar.ha + ar.wb * ar.lb * ar.hb"
    query("score_iou_bev", f"{CLIPPED} SELECT frame, e, g, round(inter / ({area} - inter), 6) AS score FROM ar")(lambda s, d: by_kernel("iou_bev", s, d))
    query("score_iou_3d", f"{CLIPPED} SELECT frame, e, g, round(inter * tall / ({volume} - inter * tall), 6) AS score FROM ar")(lambda s, d: by_kernel("iou_3d", s, d))
    query("score_plane_distance", PLANE)(lambda s, d: by_kernel("plane_distance", s, d))


def _matching() -> None:
    per_class = "CASE tg.class WHEN 'click' THEN 10 WHEN 'view' THEN 40 ELSE 20 END"
    some = "(te.class = tg.class OR (te.class IN ('click', 'view') AND tg.class IN ('click', 'view')))"
    for name, m, pairs in (
        ("match_greedy_bev", Matcher("bev_distance", 20.0, assignment="greedy"), track_pairs("20")),
        ("match_greedy_center_distance", Matcher("center_distance", 10.0, assignment="greedy"), track_pairs("10")),
        ("match_greedy_per_class_threshold", Matcher("bev_distance", 20.0, BY_CLASS, assignment="greedy"), track_pairs(per_class)),
        ("match_greedy_gate", Matcher("bev_distance", 40.0, max_distance=15.0, assignment="greedy"), track_pairs("15")),
        ("match_class_agnostic", Matcher("bev_distance", 15.0, class_agnostic=True, assignment="greedy"), track_pairs("15", "true")),
        ("match_agnostic_classes", Matcher("bev_distance", 15.0, agnostic_classes=("click", "view"), assignment="greedy"), track_pairs("15", some)),
    ):
        query(name, f"{joined(pairs)} {VERDICT}")(lambda s, d, m=m: verdict_rows(s, d, m))
    query("match_hungarian")(lambda s, d: verdict_rows(s, d, Matcher("bev_distance", 20.0, assignment="optimal")))

    query("match_status_counts", f"{joined(track_pairs('20'))} SELECT status, count(*) AS n FROM jn GROUP BY status")(lambda s, d: verdicts(s, d, Matcher("bev_distance", 20.0, assignment="greedy")).groupBy("status").agg(F.count("*").alias("n")))
    query("match_join", f"{joined(track_pairs('20'))} SELECT frame, est_index, gt_index, ec AS e_class, gc AS g_class, ei AS e_instance, gi AS g_instance FROM jn")(
        lambda s, d: match_join(verdicts(s, d, GREEDY), S.tracks(s, d, "est"), S.tracks(s, d, "gt")).select("frame", F.expr("nullif(est_index, -1)").alias("est_index"), F.expr("nullif(gt_index, -1)").alias("gt_index"), "e_class", "g_class", "e_instance", "g_instance")
    )


def _metrics() -> None:
    jn = joined(track_pairs("20"))
    both = "cl AS (SELECT ec AS class FROM jn WHERE ec IS NOT NULL UNION SELECT gc FROM jn WHERE gc IS NOT NULL UNION ALL SELECT NULL)"
    num = lambda cond, col: f"(SELECT count(*) FROM jn WHERE {cond} AND (cl.class IS NULL OR jn.{col} = cl.class))"
    tp, est, gt, fp = num("status = 0 AND ec = gc", "gc"), num("ec IS NOT NULL", "ec"), num("gc IS NOT NULL", "gc"), num("status = 1", "ec")
    counts = f"ct AS (SELECT class, CAST({tp} AS DOUBLE) AS tp, CAST({est} AS DOUBLE) AS est, {gt} AS gt, CAST({fp} AS DOUBLE) AS fp, (SELECT sum(score) FROM jn WHERE status = 0 AND ec = gc AND (cl.class IS NULL OR jn.gc = cl.class)) AS sc FROM cl)"
    query("classification", f"{jn}, {both}, {counts} SELECT class, round(tp / nullif(est + gt - tp, 0), 6) AS accuracy, round(tp / nullif(est, 0), 6) AS precision, round(tp / nullif(gt, 0), 6) AS recall, round(2 * (tp / nullif(est, 0)) * (tp / nullif(gt, 0)) / nullif(tp / nullif(est, 0) + tp / nullif(gt, 0), 0), 6) AS f1, CAST(gt AS BIGINT) AS support FROM ct")(lambda s, d: neat(M.classification(hits(s, d))))

    def switches(by):
        key = "gc AS class" if by else "CAST(NULL AS VARCHAR) AS class"
        return f"SELECT {key}, frame, gi AS g, max(ei) AS e, dense_rank() OVER ({'PARTITION BY gc ' if by else ''}ORDER BY frame) AS k FROM jn WHERE status = 0 AND ec = gc GROUP BY {'gc, ' if by else ''}frame, gi"

    sw = f"h AS ({switches(True)} UNION ALL {switches(False)}), sw AS (SELECT a.class, count(*) AS n FROM h a JOIN h b ON a.class IS NOT DISTINCT FROM b.class AND a.g = b.g AND a.k = b.k + 1 AND a.e <> b.e GROUP BY a.class)"
    query("clear", f"{jn}, {both}, {counts}, {sw} SELECT ct.class, round((tp - fp - coalesce(n, 0)) / nullif(gt, 0), 6) AS mota, round(sc / nullif(tp, 0), 6) AS motp, CAST(coalesce(n, 0) AS BIGINT) AS id_switch, CAST(gt AS BIGINT) AS support FROM ct LEFT JOIN sw ON ct.class IS NOT DISTINCT FROM sw.class")(lambda s, d: neat(M.clear(hits(s, d))))
    axis = "(SELECT unnest([" + ", ".join(f"'{c}'" for c in [*CLASSES, "background"]) + "]) AS {0})"
    query("confusion_matrix", f"{joined(track_pairs('15', 'true'))} SELECT gt_class, est_class, (SELECT count(*) FROM jn WHERE coalesce(gc, 'background') = gt_class AND coalesce(ec, 'background') = est_class) AS count FROM {axis.format('gt_class')} CROSS JOIN {axis.format('est_class')}")(
        lambda s, d: M.confusion(hits(s, d, Matcher("bev_distance", 15.0, class_agnostic=True, assignment="greedy")), CLASSES)
    )
    query("fp_validation", f"{jn}, f AS (SELECT gi AS instance, frame, status FROM jn WHERE gc = 'error' UNION ALL SELECT NULL, frame, status FROM jn WHERE gc = 'error') SELECT instance, count(DISTINCT frame) AS frames, count(*) FILTER (status = 2) AS passes, count(*) FILTER (status = 0) AS fails, round(count(*) FILTER (status = 2) / CAST(count(*) AS DOUBLE), 6) AS pass_rate FROM f GROUP BY instance")(lambda s, d: neat(M.fp_validation(hits(s, d), "error")))

    def ap(limit, rows=None, hit="CASE WHEN status = 0 AND ec = gc THEN 1.0 ELSE 0 END"):
        return f"""{rows or joined(track_pairs(limit))},
gn AS (SELECT gc AS class, count(*) AS n FROM jn WHERE gc IS NOT NULL GROUP BY gc),
rk AS (SELECT ec AS class, row_number() OVER w AS k, sum(CAST({hit} AS DOUBLE)) OVER w AS t, sum(CASE WHEN {hit} > 0 THEN 0 ELSE 1.0 END) OVER w AS f FROM jn WHERE ec IS NOT NULL WINDOW w AS (PARTITION BY ec ORDER BY c DESC, frame DESC, est_index DESC ROWS UNBOUNDED PRECEDING)),
cv AS (SELECT rk.class, k, CAST(t AS DOUBLE) / n AS r, max(CAST(t AS DOUBLE) / (t + f)) OVER (PARTITION BY rk.class ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM rk JOIN gn ON gn.class = rk.class),
kn AS (SELECT class, list(r ORDER BY k) AS rs, list(p ORDER BY k) AS ps FROM cv GROUP BY class),
gr AS (SELECT class, i / 100.0 AS x, rs, ps, len(list_filter(rs, lambda q: q <= i / 100.0 + 1e-11)) AS j FROM kn CROSS JOIN (SELECT unnest(range(11, 101)) AS i)),
va AS (SELECT class, CASE WHEN j = 0 THEN ps[1] WHEN j = len(rs) THEN CASE WHEN x <= rs[len(rs)] + 1e-11 THEN ps[len(ps)] ELSE 0 END ELSE ps[j] + (ps[j + 1] - ps[j]) * (x - rs[j]) / (rs[j + 1] - rs[j]) END AS v FROM gr),
ap AS (SELECT gn.class, coalesce(sum(greatest(v - 0.1, 0)), 0) / 90 / 0.9 AS value, gn.n AS support FROM gn LEFT JOIN va ON va.class = gn.class GROUP BY gn.class, gn.n)"""

    query("average_precision", f"{ap('20')} SELECT class, round(value, 6) AS value, CAST(support AS BIGINT) AS support FROM ap UNION ALL SELECT NULL, round(avg(value), 6), CAST(sum(support) AS BIGINT) FROM ap")(lambda s, d: neat(M.average_precision(hits(s, d))))

    def sweep(s, d):
        catalog = Catalog({"/estimation": S.tracks(s, d, "est"), "/ground_truth": S.tracks(s, d, "gt")})
        return neat(Pipeline(average_precision_sweep("/estimation", "/ground_truth", "bev_distance", (10.0, 20.0, 40.0))).run(catalog).get("/metrics/map"))

    each = " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold, * FROM ({ap(str(t))} SELECT class, value, support FROM ap)" for t in (10, 20, 40))
    query("mean_average_precision", f"WITH a AS ({each}), k AS (SELECT class, avg(value) AS value, max(support) AS support FROM a GROUP BY class) SELECT class, CAST(NULL AS DOUBLE) AS threshold, round(value, 6) AS value, CAST(support AS BIGINT) AS support FROM k UNION ALL SELECT NULL, NULL, round(avg(value), 6), CAST(sum(support) AS BIGINT) FROM k UNION ALL SELECT NULL, threshold, round(avg(value), 6), CAST(sum(support) AS BIGINT) FROM a GROUP BY threshold")(sweep)

    def box_hits(s, d):
        return stored(evaluate(S.boxes(s, d, "est"), S.boxes(s, d, "gt"), Matcher("bev_distance", 5.0, assignment="greedy")), "verdicts")

    near = "sqrt((be.x - bg.x) * (be.x - bg.x) + (be.y - bg.y) * (be.y - bg.y))"
    box_pairs = f"SELECT be.frame, be.row_idx AS e, bg.row_idx AS g, be.confidence, {near} AS score FROM be JOIN bg ON be.frame = bg.frame WHERE be.class = bg.class AND {near} <= 5"

    def over_boxes(error, aggs):
        hb = f"hb AS (SELECT jn.gc AS class, {error} AS error FROM jn JOIN be ON be.frame = jn.frame AND be.row_idx = jn.est_index JOIN bg ON bg.frame = jn.frame AND bg.row_idx = jn.gt_index WHERE jn.status = 0 AND jn.ec = jn.gc)"
        return f"{joined(box_pairs, 'be', 'bg')}, {hb} SELECT class, {aggs}, count(*) AS hits FROM hb GROUP BY class UNION ALL SELECT NULL, {aggs}, count(*) FROM hb"

    def apart(i, k):
        (ax, ay), (bx, by) = corner("be", i), corner("bg", i + k)
        return f"sqrt(({ax} - {bx}) * ({ax} - {bx}) + ({ay} - {by}) * ({ay} - {by}))"

    gaps = "least(" + ", ".join("(" + " + ".join(apart(i, k) for i in range(4)) + ") / 4" for k in range(4)) + ")"
    wrapped = "(be.yaw - bg.yaw + 3.141592653589793)"
    flip = f"abs({wrapped} - 6.283185307179586 * floor({wrapped} / 6.283185307179586) - 3.141592653589793)"
    query("corner_error", over_boxes(gaps, "round(avg(error), 6) AS mean, round(max(error), 6) AS max, round(quantile_cont(error, 0.95), 6) AS p"))(lambda s, d: neat(M.corner_error(box_hits(s, d))))
    query("heading_flip_rate", over_boxes(flip, "round(avg(CASE WHEN error > 1.5707963267948966 + 1e-9 THEN 1.0 ELSE 0 END), 6) AS value"))(lambda s, d: neat(M.heading_flip_rate(box_hits(s, d))))
    turn_back = "(jn.ey - jn.gy + 3.141592653589793)"
    off = f"abs({turn_back} - 6.283185307179586 * floor({turn_back} / 6.283185307179586) - 3.141592653589793)"
    headed = joined(box_pairs, "be", "bg").replace(" AS c FROM", " AS c, me.yaw AS ey, bg.yaw AS gy FROM")
    query("average_precision_heading", f"{ap('', headed, f'CASE WHEN status = 0 AND ec = gc THEN 1 - {off} / 3.141592653589793 ELSE 0 END')} SELECT class, round(value, 6) AS value, CAST(support AS BIGINT) AS support FROM ap UNION ALL SELECT NULL, round(avg(value), 6), CAST(sum(support) AS BIGINT) FROM ap")(lambda s, d: neat(M.average_precision(box_hits(s, d), heading=True)))
    seg = "sg AS (SELECT quality * 2 + toxic AS g, CAST(n_chars % 4 AS INT) AS e FROM labels JOIN documents USING (doc_id))"
    query("segmentation_iou", f"WITH {seg}, k AS (SELECT g AS class FROM sg UNION SELECT e FROM sg), m AS (SELECT class, (SELECT count(*) FROM sg WHERE g = class AND e = class) AS tp, (SELECT count(*) FROM sg WHERE g = class) AS gt, (SELECT count(*) FROM sg WHERE e = class) AS est FROM k), o AS (SELECT class, tp, gt, CAST(tp AS DOUBLE) / nullif(gt + est - tp, 0) AS iou, CAST(tp AS DOUBLE) / nullif(gt, 0) AS accuracy FROM m) SELECT CAST(class AS INT) AS class, round(iou, 6) AS iou, round(accuracy, 6) AS accuracy, CAST(NULL AS DOUBLE) AS pixel_accuracy, CAST(gt AS BIGINT) AS support FROM o UNION ALL SELECT NULL, round(avg(iou), 6), round(avg(accuracy), 6), round(CAST(sum(tp) AS DOUBLE) / sum(gt), 6), CAST(sum(gt) AS BIGINT) FROM o")(lambda s, d: neat(M.segmentation(S.segments(s, d))))
    four = "(SELECT CAST(unnest([0, 1, 2, 3, -2]) AS INT) AS {0})"
    query("segmentation_confusion", f"WITH {seg} SELECT gt_class, est_class, (SELECT count(*) FROM sg WHERE g = gt_class AND e = est_class) AS count FROM {four.format('gt_class')} CROSS JOIN {four.format('est_class')}")(lambda s, d: M.segmentation_confusion(S.segments(s, d), [0, 1, 2, 3]))


def _time() -> None:
    pose = POSES
    query("range_query", f"WITH {GEN} SELECT frame, row_idx, class FROM te, (SELECT min(frame) AS a FROM te) WHERE frame >= a + 10 AND frame < a + 50")(lambda s, d: _ranged(S.tracks(s, d, "est")))
    query("latest_at", f"WITH {GEN} SELECT frame, row_idx, class FROM te WHERE frame = (SELECT max(frame) FROM te WHERE frame <= 9999999)")(lambda s, d: T.latest_at(S.tracks(s, d, "est"), 9999999).select("frame", "row_idx", "class"))
    query("entity_times", f"WITH {GEN} SELECT DISTINCT frame FROM te")(lambda s, d: T.times(S.tracks(s, d, "est")))

    def probes(s, d):
        return S.boxes(s, d, "est").withColumn("t", F.col("frame") + 1).withColumn("axis", F.lit(0)).select("axis", "t", "frame", "row_idx", "x", "y", "z")

    def moved(s, d, policy):
        got = T.lookup(probes(s, d), S.poses(s, d).withColumn("axis", F.lit(0)), policy, ["axis"]).where("pose IS NOT NULL")
        return neat(T.transform(got).select("frame", "row_idx", "x", "y", "z"))

    apply_ = "round(b.x * cos(po.yaw) - b.y * sin(po.yaw) + tx, 6) AS x, round(b.x * sin(po.yaw) + b.y * cos(po.yaw) + ty, 6) AS y, round(b.z, 6) AS z"
    query("transform_latest", f"WITH {BOX}, {pose} SELECT b.frame, b.row_idx, {apply_} FROM be b ASOF JOIN po ON b.frame + 1 >= po.t")(lambda s, d: moved(s, d, "latest"))
    query("transform_exact", f"WITH {BOX}, {pose} SELECT b.frame, b.row_idx, {apply_} FROM be b JOIN po ON po.t = b.frame + 1")(lambda s, d: moved(s, d, "exact"))
    query("transform_nearest", f"WITH {BOX}, {pose} SELECT b.frame, b.row_idx, {apply_} FROM be b JOIN (SELECT frame, min_by(t, (abs(t - frame - 1), t)) AS pt FROM (SELECT DISTINCT frame FROM be) CROSS JOIN po GROUP BY frame) n ON n.frame = b.frame JOIN po ON po.t = n.pt")(lambda s, d: moved(s, d, "nearest"))
    bent = "(hi.yaw - lo.yaw + 3.141592653589793)"
    turn = f"lo.yaw + s * ({bent} - 6.283185307179586 * floor({bent} / 6.283185307179586) - 3.141592653589793)"
    mid = f"""fr AS (SELECT frame, (SELECT max(t) FROM po WHERE t <= frame + 1) AS a, (SELECT min(t) FROM po WHERE t >= frame + 1) AS b FROM (SELECT DISTINCT frame FROM be)),
sh AS (SELECT frame, coalesce(a, b) AS a, coalesce(b, a) AS b, CASE WHEN a < b THEN (frame + 1 - a) / CAST(b - a AS DOUBLE) ELSE 0 END AS s FROM fr),
po2 AS (SELECT frame, lo.tx + s * (hi.tx - lo.tx) AS tx, lo.ty + s * (hi.ty - lo.ty) AS ty, {turn} AS yaw FROM sh JOIN po lo ON lo.t = sh.a JOIN po hi ON hi.t = sh.b)"""
    query("transform_interpolate", f"WITH {BOX}, {pose}, {mid} SELECT b.frame, b.row_idx, {apply_.replace('po.', 'po2.')} FROM be b JOIN po2 ON po2.frame = b.frame")(lambda s, d: moved(s, d, "interpolate"))

    def paired(s, d):
        a = S.tracks(s, d, "gt").select((F.col("frame") * 10).alias("t")).distinct()
        b = S.tracks(s, d, "est").select((F.col("frame") * 10 + 3).alias("t")).distinct()
        return T.pair_times(a, b, 5)

    query("pair_times", f"WITH {GEN} SELECT a.t AS reference, b.t AS query FROM (SELECT DISTINCT frame * 10 AS t FROM tg) a JOIN (SELECT DISTINCT frame * 10 + 3 AS t FROM te) b ON b.t = a.t + 3")(paired)
    query("instance_intern", f"WITH {GEN}, f AS (SELECT instance, min((frame, row_idx)) AS k FROM te GROUP BY instance) SELECT instance, row_number() OVER (ORDER BY k, instance) - 1 AS instance_id FROM f")(lambda s, d: intern(S.tracks(s, d, "est"), "instance", ["frame", "row_idx"]))
    names = LabelRegistry(tuple(CLASSES))
    query("label_encode", "SELECT event_id, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS INT) AS class_id FROM events")(lambda s, d: S.table(s, d, "events").select("event_id", names.encode(F.col("event_type"), "unknown").cast("int").alias("class_id")))


def _paths() -> None:
    axis = lambda k: f"(SELECT unnest(range({k})) AS {{0}})"
    base = f"""WITH p AS (SELECT a.vec_id AS id, a.label AS ec, b.label AS gc, a.embedding AS e, b.embedding AS g FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
md AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY e[61 + m] DESC, m DESC) AS rk FROM p CROSS JOIN {axis(4).format('m')} WHERE ec = gc),
tm AS (SELECT *, least((q + 1) * 3 // 2, 5) AS a, least((q + 1) * 3 // 2 + 1, 5) AS b, CASE WHEN (q + 1) * 3 // 2 < 5 THEN ((q + 1) * 150 - (q + 1) * 3 // 2 * 100) / 100.0 ELSE 0 END AS w FROM md CROSS JOIN {axis(5).format('q')}),
kn AS (SELECT *, {", ".join(f"CAST(CASE WHEN {i} = 0 THEN e[{c}] ELSE e[m * 15 + {i} * 3 - 3 + {c}] END AS DOUBLE) AS {n}{i}" for i in "ab" for c, n in ((1, "x"), (2, "y")))}, CAST(g[q * 3 + 1] AS DOUBLE) AS gx, CAST(g[q * 3 + 2] AS DOUBLE) AS gy FROM tm),
ds AS (SELECT id, gc, rk, q, sqrt((xa + w * (xb - xa) - gx) * (xa + w * (xb - xa) - gx) + (ya + w * (yb - ya) - gy) * (ya + w * (yb - ya) - gy)) AS d FROM kn),
mo AS (SELECT id, gc, rk, avg(d) AS ade, max_by(d, q) AS fde, count(*) FILTER (d >= 0.25) AS misses, count(*) AS steps FROM ds GROUP BY id, gc, rk),
ks AS (SELECT unnest([1, 3, 6]) AS k),
"""
    tail = """cl AS (SELECT class, (SELECT count(*) FROM p WHERE c.class IS NULL OR gc = c.class) AS n FROM (SELECT gc AS class FROM p UNION SELECT ec FROM p UNION SELECT NULL) c)
SELECT CAST(class AS INT) AS class, CAST(ks.k AS INT) AS k, round(avg(ade), 6) AS ade, round(avg(fde), 6) AS fde, round(sum(misses) / CAST(sum(steps) AS DOUBLE), 6) AS miss_rate, CAST(n AS BIGINT) AS support
FROM cl CROSS JOIN ks LEFT JOIN ob ON ob.k = ks.k AND (class IS NULL OR ob.gc = class) GROUP BY class, n, ks.k"""
    mean = "ob AS (SELECT id, gc, k, avg(ade) AS ade, avg(fde) AS fde, sum(misses) AS misses, sum(steps) AS steps FROM mo JOIN ks ON rk <= k GROUP BY id, gc, k), "
    best = "ob AS (SELECT id, gc, k, min(ade) AS ade, min(fde) AS fde, min_by(misses, (ade, rk)) AS misses, min_by(steps, (ade, rk)) AS steps FROM mo JOIN ks ON rk <= k GROUP BY id, gc, k), "
    for name, part, flag in (("path_displacement", mean, False), ("path_displacement_best", best, True)):
        query(name, base + part + tail)(lambda s, d, flag=flag: neat(D.path_displacement(S.paths(s, d), tolerance=0.25, best_of_k=flag)))


def _more() -> None:
    speed = "SELECT event_id, value / 10 AS vx, event_id % 7 AS vy FROM events WHERE event_id % 5 <> 0"

    def quick(s, d):
        lost = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan")))
        rows = S.table(s, d, "events").select("event_id", lost.otherwise(F.col("value") / 10).alias("vx"), (F.col("event_id") % 7).cast("double").alias("vy"), F.lit(0.0).alias("vz"))
        return rows.where(L.by_speed(2, 6)).select("event_id")

    query("filter_speed", f"SELECT event_id FROM ({speed}) WHERE sqrt(vx * vx + vy * vy) BETWEEN 2 AND 6")(quick)
    pts = "SELECT vec_id % 10 AS frame, vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings"
    square = [(-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1)]
    turn = "(atan2(y, x) - 0.1 - 6.283185307179586 * floor((atan2(y, x) - 0.1) / 6.283185307179586))"
    for name, predicate, where in (
        ("filter_points_region", lambda: L.by_region((-0.1, -0.05), (0.2, 0.1)), "x BETWEEN -0.1 AND 0.2 AND y BETWEEN -0.05 AND 0.1"),
        ("filter_points_polar_grid", lambda: L.by_polar_grid(0.05, 0.3, 0.1, 2.1), f"sqrt(x * x + y * y) BETWEEN 0.05 AND 0.3 AND {turn} <= 2 + 1e-9"),
        ("filter_points_map", lambda: L.by_map([square]), "x > -0.1 AND x < 0.1 AND y > -0.1 AND y < 0.1"),
    ):
        query(name, f"SELECT frame, point_id FROM ({pts}) WHERE {where}")(lambda s, d, p=predicate: S.points(s, d).where(p()).select("frame", "point_id"))
    query("mask_selected", f"WITH {BOX} SELECT frame, count(*) FILTER (confidence BETWEEN 0.5 AND 1) AS selected, count(*) AS total FROM be GROUP BY frame")(lambda s, d: L.selected(L.mask(S.boxes(s, d, "est"), L.by_confidence(0.5, 1))))
    query("box_sizes", f"WITH {BOX} SELECT frame, row_idx, round(w * l, 6) AS area, round(w * l * h, 6) AS volume, CAST(rw * rh AS BIGINT) AS roi FROM be")(
        lambda s, d: neat(S.boxes(s, d, "est").select("frame", "row_idx", G.bev_area().alias("area"), G.volume().alias("volume"), G.roi_area().cast("long").alias("roi")))
    )
    turned = "SELECT o_orderkey AS k, o_totalprice / 1000 AS x, CAST(o_custkey % 100 AS DOUBLE) AS y, 2 * 3.141592653589793 * (o_custkey % 360) / 360 AS a FROM orders"

    def turns(s, d, back):
        half = F.lit(math.pi) * (F.col("o_custkey") % 360) / 360
        p = P.pose(F.col("o_totalprice") / 1000, (F.col("o_custkey") % 100).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.sin(half), F.cos(half))
        rows = S.table(s, d, "orders").select(F.col("o_orderkey").alias("k"), p.alias("p"))
        rows = rows.select("k", (P.invert(F.col("p")) if back else P.compose(F.col("p"), F.col("p"))).alias("q"))
        return neat(rows.select("k", F.col("q.tx").alias("x"), F.col("q.ty").alias("y"), F.abs(F.col("q.qw")).alias("w")))

    query("pose_invert", f"SELECT k, round(-(x * cos(a) + y * sin(a)), 6) AS x, round(x * sin(a) - y * cos(a), 6) AS y, round(abs(cos(a / 2)), 6) AS w FROM ({turned})")(lambda s, d: turns(s, d, True))
    query("pose_compose", f"SELECT k, round(x + x * cos(a) - y * sin(a), 6) AS x, round(y + x * sin(a) + y * cos(a), 6) AS y, round(abs(cos(a)), 6) AS w FROM ({turned})")(lambda s, d: turns(s, d, False))

    def grouped(s, d):
        """Matching by class after similar classes became one."""
        one = LabelRegistry(tuple(CLASSES))
        few = one.merged({"visit": ["click", "view"]})
        side = lambda k: S.tracks(s, d, k).withColumn("class", few.decode(one.remap(few, one.encode(F.col("class")))))
        return verdicts_of(side("est"), side("gt"), Matcher("bev_distance", 20.0, assignment="greedy")).groupBy("g_class").agg(F.count_if(F.col("status") == 0).alias("hits"), F.count("*").alias("n")).where("g_class IS NOT NULL")

    coarse = GEN.replace("event_type AS class", "CASE WHEN event_type IN ('click', 'view') THEN 'visit' ELSE event_type END AS class")
    query("grouped_labels", joined(track_pairs("20")).replace(GEN, coarse) + " SELECT gc AS g_class, count(*) FILTER (status = 0) AS hits, count(*) AS n FROM jn WHERE gc IS NOT NULL GROUP BY gc")(grouped)

    def moved_frames(s, d):
        """Estimates on the ground truth's frames: clocks differ by 3, frames by a running number."""
        gt, est = S.tracks(s, d, "gt"), S.tracks(s, d, "est")
        ref = gt.select("frame", (F.col("frame") * 10).alias("t")).distinct()
        own = est.select((F.col("frame") + 1000000).alias("frame"), (F.col("frame") * 10 + 3).alias("t")).distinct()
        return A.align(est.withColumn("frame", F.col("frame") + 1000000), A.frame_pairs(ref, own, 5)).select("frame", "row_idx", "class")

    query("align_frames", f"WITH {GEN} SELECT frame, row_idx, class FROM te WHERE frame IN (SELECT frame FROM tg)")(moved_frames)
    agnostic = Matcher("bev_distance", 15.0, class_agnostic=True, assignment="greedy")
    cells = ", ".join(f"CAST(count(*) FILTER (coalesce(ec, 'background') = '{c}') AS BIGINT) AS {c}" for c in [*CLASSES, "background"])
    query("confusion_as_matrix", f"{joined(track_pairs('15', 'true'))} SELECT a.gt_class, {cells.replace('ec,', 'jn.ec,').replace('count(*)', 'count(jn.frame)')} FROM (SELECT unnest([{', '.join(repr(c) for c in [*CLASSES, 'background'])}]) AS gt_class) a LEFT JOIN jn ON coalesce(jn.gc, 'background') = a.gt_class GROUP BY a.gt_class")(
        lambda s, d: M.as_matrix(M.confusion(hits(s, d, agnostic), CLASSES), [*CLASSES, "background"])
    )


def verdicts_of(est: DataFrame, gt: DataFrame, m: Matcher) -> DataFrame:
    return evaluate(est, gt, m)


def _ranged(rows: DataFrame) -> DataFrame:
    low = rows.agg(F.min("frame")).first()[0]
    return T.time_range(rows, low + 10, low + 50, open_high=True).select("frame", "row_idx", "class")


def _catalog() -> None:
    """The store: writes, static columns, selections, recordings."""
    cut = "confidence BETWEEN 0.5 AND 1"

    def store(s, d):
        """Each entity in two writes, by the parity of the hour."""
        out, rows = Store(s), S.tracks(s, d, "est").select("frame", "row_idx", "class", "x")
        for k in (0, 1):
            out.send("/est", rows.where(F.pmod("frame", F.lit(2)) == k))
        return out

    query("concat_entities", f"WITH {GEN} SELECT frame, row_idx, class FROM te UNION ALL SELECT frame, row_idx, class FROM tg")(lambda s, d: concat([S.tracks(s, d, k).select("frame", "row_idx", "class") for k in ("est", "gt")]))
    query("partition_sizes", f"WITH {GEN} SELECT frame, frame % 2 AS chunk_seq, count(*) AS n FROM te GROUP BY ALL")(lambda s, d: store(s, d).partitions("/est"))

    def overlaid(s, d):
        out = store(s, d)
        out.log_static("/est", s.range(1).select(F.lit("lidar").alias("sensor"), F.lit(1.5).alias("x")))
        return out.range("/est").select("frame", "row_idx", "class", "sensor", "x")

    query("static_overlay", f"WITH {GEN} SELECT frame, row_idx, class, 'lidar' AS sensor, CAST(1.5 AS DOUBLE) AS x FROM te")(overlaid)

    def newest(s, d):
        out, rows = store(s, d), S.tracks(s, d, "gt").select("frame", "row_idx", "class", "x")
        out.send("/est", rows)  # a later write of the same frames
        return out.latest_at("/est", 9999999).select("frame", "row_idx", "class")

    query("latest_write", f"WITH {GEN}, f AS (SELECT max(frame) AS frame FROM (SELECT frame FROM te UNION ALL SELECT frame FROM tg)) SELECT frame, row_idx, class FROM tg WHERE frame = (SELECT frame FROM f) UNION ALL SELECT frame, row_idx, class FROM te WHERE frame = (SELECT frame FROM f) AND frame NOT IN (SELECT frame FROM tg)")(newest)
    query("select_rows_by_mask", f"WITH {BOX} SELECT frame, row_idx, class FROM be WHERE {cut}")(lambda s, d: kept_rows(S.boxes(s, d, "est"), L.by_confidence(0.5, 1)).select("frame", "row_idx", "class"))
    query("masked_view", f"WITH {BOX} SELECT class, count(*) AS n FROM be WHERE {cut} GROUP BY class")(lambda s, d: kept_rows(S.boxes(s, d, "est"), L.by_confidence(0.5, 1)).groupBy("class").agg(F.count("*").alias("n")))
    query("narrow_frames", f"WITH {GEN}, f AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS i FROM (SELECT DISTINCT frame FROM te)) SELECT te.frame, row_idx FROM te JOIN f ON f.frame = te.frame WHERE i >= 3 AND i < 60 AND (i - 3) % 4 = 0")(lambda s, d: narrow(S.tracks(s, d, "est"), slice(3, 60, 4)).select("frame", "row_idx"))

    def round_trip(s, d):
        path = Scratch(s, "recording").path
        write_recording({"/est": S.tracks(s, d, "est"), "/gt": S.tracks(s, d, "gt")}, path, LabelRegistry(tuple(CLASSES)))
        return read_recording(s, path)[0]["/est"].select("frame", "row_idx", "class", "instance")

    query("recording_roundtrip", f"WITH {GEN} SELECT frame, row_idx, class, instance FROM te")(round_trip)
    one = LabelRegistry(tuple(CLASSES))
    few = one.merged({"visit": ["click", "view"]})
    query("label_merge_remap", "SELECT event_id, CAST(list_position(['visit', 'error', 'purchase', 'signup'], CASE WHEN event_type IN ('click', 'view') THEN 'visit' ELSE event_type END) - 1 AS INT) AS class_id FROM events")(lambda s, d: S.table(s, d, "events").select("event_id", one.remap(few, one.encode(F.col("event_type"))).cast("int").alias("class_id")))
    squares = [[(0.0, 0.0), (20.0, 0.0), (20.0, 5.0), (0.0, 5.0)], [(20.0, 0.0), (45.0, 0.0), (45.0, 5.0), (20.0, 5.0)]]

    def joined_map(s, d):
        rows = S.boxes(s, d, "est")
        lanes = s.createDataFrame([([{"x": x, "y": y} for x, y in q],) for q in squares], "ring array<struct<x:double,y:double>>")
        marks = L.in_map(rows, lanes, 10.0)
        both = L.combine([marks, L.mask(rows, L.by_map(squares))], "all")
        return marks.join(both.withColumnRenamed("mask", "again"), ["frame", "row_idx"])

    union = "x > 0 AND x < 45 AND y > 0 AND y < 5"
    query("filter_map_union", f"WITH {BOX} SELECT frame, row_idx, {union} AS mask, {union} AS again FROM be")(joined_map)


def _recordings() -> None:
    """Two recordings in one table give what each alone gives."""
    split = GEN.replace("CAST(floor(epoch(ts) / 3600) AS BIGINT) AS frame", "CAST(floor(epoch(ts) / 3600) AS BIGINT) * 2 + user_id % 2 AS frame")

    def side(s, d, k):
        rows = S.tracks(s, d, k).withColumn("recording", F.col("instance") % 2)
        return rows.withColumn("row_idx", (F.row_number().over(Window.partitionBy("recording", "frame").orderBy("row_idx")) - 1).cast("long"))

    def matched(s, d):
        got = match(side(s, d, "est"), side(s, d, "gt"), GREEDY).drop("threshold")
        return neat(got.withColumn("frame", F.col("frame") * 2 + F.col("recording")).drop("recording"))

    query("match_two_recordings", f"{joined(track_pairs('20')).replace(GEN, split)} {VERDICT}")(matched)


def _frames() -> None:
    """Coordinate frames: static and moving hops, orientations."""
    pose = POSES
    hop = {"base": (1.0, 2.0, 0.0, 0.3), "lidar": (0.5, -1.0, 1.0, -0.7)}

    def static(s):
        rows = [(None, p, c, x, y, z, 0.0, 0.0, math.sin(a / 2), math.cos(a / 2)) for (p, c), (x, y, z, a) in zip((("map", "base"), ("base", "lidar")), hop.values())]
        return s.createDataFrame(rows, "t long, parent string, child string, tx double, ty double, tz double, qx double, qy double, qz double, qw double")

    def rows(s, d):
        return S.boxes(s, d, "est").select("frame", "row_idx", "x", "y", "z", "yaw", F.lit("lidar").alias("frame_id"))

    def out(got):
        return neat(got.select("frame", "row_idx", "x", "y", "z", F.cos("yaw").alias("c"), F.sin("yaw").alias("s")))

    def turned(x, y, a, p, q):
        return f"({p} + {x} * cos({a}) - {y} * sin({a}))", f"({q} + {x} * sin({a}) + {y} * cos({a}))"

    (bx, by, bz, ba), (lx, ly, lz, la) = hop.values()
    at_base = turned("b.x", "b.y", la, lx, ly)
    at_map = turned(*at_base, ba, bx, by)
    query("transform_static", f"WITH {BOX} SELECT frame, row_idx, round({at_map[0]}, 6) AS x, round({at_map[1]}, 6) AS y, round(z + {lz + bz}, 6) AS z, round(cos(yaw + {la + ba}), 6) AS c, round(sin(yaw + {la + ba}), 6) AS s FROM be b")(lambda s, d: out(T.in_frame(rows(s, d), "map", T.Resolver(static(s)))))

    def chained(s, d):
        edges = static(s).where("child = 'lidar'").unionByName(S.poses(s, d))
        moved = rows(s, d).join(S.poses(s, d).agg(F.min("t").alias("first")), F.expr("frame >= first"))
        return out(T.in_frame(moved, "map", T.Resolver(edges)))

    moving = turned(*at_base, "po.yaw", "po.tx", "po.ty")
    query("frame_graph_path", f"WITH {BOX}, {pose} SELECT b.frame, row_idx, round({moving[0]}, 6) AS x, round({moving[1]}, 6) AS y, round(z + {lz}, 6) AS z, round(cos(b.yaw + {la} + po.yaw), 6) AS c, round(sin(b.yaw + {la} + po.yaw), 6) AS s FROM be b ASOF JOIN po ON b.frame >= po.t")(chained)

    def oriented(s, d):
        probes = S.boxes(s, d, "est").withColumn("t", F.col("frame")).select("t", "frame", "row_idx", "x", "y", "z", "yaw")
        return out(T.transform(T.lookup(probes, S.poses(s, d), "latest").where("pose IS NOT NULL")))

    own = turned("b.x", "b.y", "po.yaw", "po.tx", "po.ty")
    query("transform_box_orientation", f"WITH {BOX}, {pose} SELECT b.frame, row_idx, round({own[0]}, 6) AS x, round({own[1]}, 6) AS y, round(z, 6) AS z, round(cos(b.yaw + po.yaw), 6) AS c, round(sin(b.yaw + po.yaw), 6) AS s FROM be b ASOF JOIN po ON b.frame >= po.t")(oriented)
    query("latest_at_asof", f"WITH {BOX}, {pose} SELECT f.frame AS t, po.t AS sample FROM (SELECT DISTINCT frame FROM be) f ASOF LEFT JOIN po ON f.frame >= po.t")(lambda s, d: T.as_of(S.boxes(s, d, "est").select(F.col("frame").alias("t")).distinct(), S.poses(s, d).select("t", "tx")).select("t", F.col("sample.t").alias("sample")))

    def paired(s, d):
        gt, est = S.tracks(s, d, "gt"), S.tracks(s, d, "est")
        ref = gt.select("frame", (F.col("frame") * 10).alias("t")).distinct()
        own = est.select((F.col("frame") + 1000000).alias("frame"), (F.col("frame") * 10 + 3).alias("t")).distinct()
        return gt, est.withColumn("frame", F.col("frame") + 1000000), A.frame_pairs(ref, own, 5)

    query("reindex_frames", f"WITH {GEN} SELECT frame, count(*) AS n FROM te WHERE frame IN (SELECT frame FROM tg) GROUP BY frame")(lambda s, d: (lambda g, e, p: A.align(e, p).groupBy("frame").agg(F.count("*").alias("n")))(*paired(s, d)))
    query("drop_unmatched_frames", f"WITH {GEN} SELECT frame, row_idx, class FROM tg WHERE frame IN (SELECT frame FROM te)")(lambda s, d: (lambda g, e, p: A.drop_frames(g, p).select("frame", "row_idx", "class"))(*paired(s, d)))


def _images() -> None:
    """Label images of 8 x 8 pixels from embeddings."""

    def image(shift):
        label = lambda i: F.pmod(F.floor(F.get("embedding", i).cast("double") * 50 + shift), F.lit(4)).cast("int")
        return F.array(*(F.array(*(label(F.lit(r * 8 + c)) for c in range(8))) for r in range(8)))

    def labelled(s, d):
        rows = S.table(s, d, "embeddings")
        side = lambda shift: M.pixels(rows.select(F.col("vec_id").alias("frame"), image(shift).alias("image")))
        return M.elements(side(0.3), side(0.0))

    px = "px AS (SELECT unnest(embedding) AS v FROM embeddings), lb AS (SELECT CAST(floor(CAST(v AS DOUBLE) * 50) AS BIGINT) AS a, CAST(floor(CAST(v AS DOUBLE) * 50 + 0.3) AS BIGINT) AS b FROM px), sg AS (SELECT ((a % 4) + 4) % 4 AS g, ((b % 4) + 4) % 4 AS e FROM lb)"
    iou = "m AS (SELECT class, (SELECT count(*) FROM {0} WHERE g = class AND e = class) AS tp, (SELECT count(*) FROM {0} WHERE g = class) AS gt, (SELECT count(*) FROM {0} WHERE e = class) AS est FROM k), o AS (SELECT class, tp, gt, CAST(tp AS DOUBLE) / nullif(gt + est - tp, 0) AS iou, CAST(tp AS DOUBLE) / nullif(gt, 0) AS accuracy FROM m) SELECT CAST(class AS INT) AS class, round(iou, 6) AS iou, round(accuracy, 6) AS accuracy, CAST(NULL AS DOUBLE) AS pixel_accuracy, CAST(gt AS BIGINT) AS support FROM o UNION ALL SELECT NULL, round(avg(iou), 6), round(avg(accuracy), 6), round(CAST(sum(tp) AS DOUBLE) / sum(gt), 6), CAST(sum(gt) AS BIGINT) FROM o"
    query("segmentation_image_iou", f"WITH {px}, k AS (SELECT unnest([0, 1, 2, 3]) AS class), {iou.format('sg')}")(lambda s, d: neat(M.segmentation(labelled(s, d), classes=[0, 1, 2, 3])))
    # class 3 is ignored: it leaves the axis, and estimates of it are background
    query("segmentation_offaxis", f"WITH {px}, st AS (SELECT g, e FROM sg WHERE g <> 3), k AS (SELECT unnest([0, 1, 2]) AS class), {iou.format('st')}")(lambda s, d: neat(M.segmentation(labelled(s, d), ignore=[3], classes=[0, 1, 2, 3])))
    four = "(SELECT CAST(unnest([0, 1, 2, -2]) AS INT) AS {0})"
    query("segmentation_confusion_offaxis", f"WITH {px} SELECT gt_class, est_class, (SELECT count(*) FROM sg WHERE g = gt_class AND (e = est_class OR (est_class = -2 AND e = 3))) AS count FROM {four.format('gt_class')} CROSS JOIN {four.format('est_class')}")(lambda s, d: M.segmentation_confusion(labelled(s, d), [0, 1, 2, 3], [3]))


def _axes() -> None:
    """Metrics on a registry's axis, which has a class without objects, and other scores."""
    every = [*CLASSES, "zebra"]
    jn = joined(track_pairs("20"))
    axis = "ax AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in every) + "]) AS class UNION ALL SELECT NULL)"
    num = lambda cond, col: f"(SELECT count(*) FROM jn WHERE {cond} AND (ax.class IS NULL OR jn.{col} = ax.class))"
    tp, est, gt = num("status = 0 AND ec = gc", "gc"), num("ec IS NOT NULL", "ec"), num("gc IS NOT NULL", "gc")
    query("classification_on_axis", f"{jn}, {axis}, ct AS (SELECT class, CAST({tp} AS DOUBLE) AS tp, CAST({est} AS DOUBLE) AS est, {gt} AS gt FROM ax) SELECT class, round(tp / nullif(est, 0), 6) AS precision, round(tp / nullif(gt, 0), 6) AS recall, CAST(gt AS BIGINT) AS support FROM ct")(lambda s, d: neat(M.classification(hits(s, d), every).select("class", "precision", "recall", "support")))
    query("fp_validation_by_class", f"{jn}, {axis}, r AS (SELECT count(*) FILTER (status = 2) / CAST(nullif(count(*), 0) AS DOUBLE) AS v, count(*) AS n FROM jn WHERE gc = 'error') SELECT class, CASE WHEN class IS NULL OR class = 'error' THEN round(v, 6) END AS value, CASE WHEN class IS NULL OR class = 'error' THEN n ELSE 0 END AS support FROM ax CROSS JOIN r")(lambda s, d: neat(M.fp_validation_by_class(hits(s, d), "error", every)))
    over = lambda a, n: f"greatest(0.0, least(be.{a} + be.{n}, bg.{a} + bg.{n}) - greatest(be.{a}, bg.{a}))"
    inter = f"({over('rx', 'rw')} * {over('ry', 'rh')})"
    iou = f"{inter} / (be.rw * be.rh + bg.rw * bg.rh - {inter})"
    roi_pairs = f"SELECT be.frame, be.row_idx AS e, bg.row_idx AS g, be.confidence, -({iou}) AS score FROM be JOIN bg ON be.frame = bg.frame WHERE be.class = bg.class AND {iou} >= 0.3"
    query("match_greedy_iou_roi", f"{joined(roi_pairs, 'be', 'bg')} {VERDICT.replace('round(score, 6)', 'round(-score, 6)')}")(lambda s, d: neat(match(S.boxes(s, d, "est"), S.boxes(s, d, "gt"), Matcher("iou_roi", 0.3, assignment="greedy")).drop("threshold")))
    manhattan = "abs(te.x - tg.x) + abs(te.y - tg.y)"
    own_pairs = f"SELECT te.frame, te.row_idx AS e, tg.row_idx AS g, te.confidence, {manhattan} AS score FROM te JOIN tg ON te.frame = tg.frame WHERE te.class = tg.class AND {manhattan} <= 25"
    own = lambda a, b: F.abs(F.col(a + "x") - F.col(b + "x")) + F.abs(F.col(a + "y") - F.col(b + "y"))
    query("match_custom_score", f"{joined(own_pairs)} {VERDICT}")(lambda s, d: verdict_rows(s, d, Matcher(own, 25.0, larger=False, assignment="greedy")))
    for name, score, limit in (("match_iou_bev", "iou_bev", 0.1), ("match_iou_3d", "iou_3d", 0.1), ("match_plane_distance", "plane_distance", 3.0)):
        query(name)(lambda s, d, m=Matcher(score, limit, assignment="greedy"): neat(match(S.boxes(s, d, "est"), S.boxes(s, d, "gt"), m).drop("threshold")))


def kept_rows(rows: DataFrame, predicate) -> DataFrame:
    return L.masked(rows, L.mask(rows, predicate))


for _part in (_filters, _masks, _scores, _matching, _metrics, _time, _paths, _more, _catalog, _recordings, _frames, _images, _axes):
    _part()


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict:
    return dict(_SQL)
