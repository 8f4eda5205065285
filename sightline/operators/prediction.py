"""Predicted paths against what happened: ADE, FDE and miss rate.

A path is an array of ``(t, x, y)``: times from now on, padding left out.  An estimate carries
``modes``, an array of ``(confidence, steps)``; ground truth carries ``future``, one path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STILL = "CAST(array(named_struct('confidence', 0D, 'steps', array())) AS array<struct<confidence:double,steps:array<struct<t:bigint,x:double,y:double>>>>)"


def ranked_modes(modes: Column) -> Column:
    """Modes that have a step, the most confident first, of equal ones the later; none: standing still."""
    numbered = F.transform(modes, lambda m, i: F.struct((-m["confidence"]).alias("c"), (-i).alias("i"), m["confidence"].alias("confidence"), m["steps"].alias("steps")))
    offered = F.filter(numbered, lambda m: F.size(m["steps"]) > 0)
    plain = F.transform(F.array_sort(offered), lambda m: F.struct(m["confidence"].alias("confidence"), m["steps"].alias("steps")))
    return F.when(F.size(plain) > 0, plain).otherwise(F.expr(_STILL))


def knots(steps: Column, x: Column, y: Column) -> Column:
    """Steps by time, after the present position unless a step lies at time 0."""
    start = F.array(F.struct(F.lit(0).cast("long").alias("t"), x.cast("double").alias("x"), y.cast("double").alias("y")))
    own = F.transform(steps, lambda s: F.struct(s["t"].cast("long").alias("t"), s["x"].cast("double").alias("x"), s["y"].cast("double").alias("y")))
    return F.array_sort(F.when(F.exists(steps, lambda s: s["t"] == 0), own).otherwise(F.concat(start, own)))


def position_at(path: Column, t: Column) -> Column:
    """(x, y) of a path at a time: straight between knots, the first or last one's outside them."""
    before, after = F.filter(path, lambda k: k["t"] <= t), F.filter(path, lambda k: k["t"] > t)
    low = F.coalesce(F.try_element_at(before, F.lit(-1)), F.try_element_at(path, F.lit(1)))
    high = F.coalesce(F.try_element_at(after, F.lit(1)), F.try_element_at(path, F.lit(-1)))
    span = high["t"] - low["t"]
    share = F.when(span > 0, F.least(F.greatest((t - low["t"]) / span, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.struct((low["x"] + share * (high["x"] - low["x"])).alias("x"), (low["y"] + share * (high["y"] - low["y"])).alias("y"))


def _gap(path: Column, step: Column) -> Column:
    at = position_at(path, step["t"])
    dx, dy = at["x"] - step["x"], at["y"] - step["y"]
    return F.sqrt(dx * dx + dy * dy)


def mode_errors(joined: DataFrame, keep: int, tolerance: float) -> DataFrame:
    """Label-correct pairs with a future, and ``errors`` of their ``keep`` most confident modes."""
    rows = joined.where("label_correct AND size(g_future) > 0")
    rows = rows.withColumn("modes", F.slice(ranked_modes(F.col("e_modes")), 1, keep)).withColumn("future", F.expr("array_sort(g_future, (a, b) -> CASE WHEN a.t < b.t THEN -1 WHEN a.t > b.t THEN 1 ELSE 0 END)"))
    rows = rows.withColumn("paths", F.transform("modes", lambda m: knots(m["steps"], F.col("e_x"), F.col("e_y"))))
    rows = rows.withColumn("gaps", F.transform("paths", lambda p: F.transform("future", lambda s: _gap(p, s))))
    add = lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + b)
    error = lambda g: F.struct((add(g) / F.size(g)).alias("ade"), F.element_at(g, -1).alias("fde"), F.size(F.filter(g, lambda d: d >= tolerance)).alias("misses"), F.size(g).alias("steps"))
    return rows.select(F.col("g_class").alias("class"), F.transform("gaps", error).alias("errors"))


def path_displacement(joined: DataFrame, top_k: tuple[int, ...] = (1, 3, 6), tolerance: float = 2.0, best_of_k: bool = False) -> DataFrame:
    """(class, k, ade, fde, miss_rate, support) of joined matches; the null class pools all objects.

    An object's ADE and FDE are means over its k most confident modes, or with ``best_of_k`` the
    smallest of each; then objects are averaged.  A miss is a step off by ``tolerance`` or more, over
    the modes scored (``best_of_k``: the mode of the smallest ADE).  Support counts ground truth;
    a class without a scored object has null errors.
    """
    if not top_k or min(top_k) < 1 or len(set(top_k)) != len(top_k):
        raise ValueError(f"top_k must hold distinct values of at least 1, got {top_k}")
    if tolerance <= 0:
        raise ValueError("the tolerance must be positive")

    def reduced(k: int) -> Column:
        some = F.slice("errors", 1, k)
        of = lambda name: F.transform(some, lambda e: e[name])
        total = lambda name: F.aggregate(of(name), F.lit(0.0), lambda a, b: a + b)
        if best_of_k:
            best = F.element_at(some, F.array_position(of("ade"), F.array_min(of("ade"))).cast("int"))
            parts = F.array_min(of("ade")), F.array_min(of("fde")), best["misses"].cast("double"), best["steps"].cast("double")
        else:
            parts = total("ade") / F.size(some), total("fde") / F.size(some), total("misses"), total("steps")
        return F.struct(F.lit(k).alias("k"), *(p.alias(n) for p, n in zip(parts, ("ade", "fde", "misses", "steps"))))

    scored = mode_errors(joined, max(top_k), tolerance).select("class", F.explode(F.array(*map(reduced, top_k))).alias("r")).select("class", "r.*")
    sums = ("ade", "fde", "misses", "steps")
    by = scored.groupBy("class", "k").agg(*(F.sum(c).alias(c) for c in sums), F.count("*").alias("objects"))
    truth = joined.where("g_class IS NOT NULL").groupBy(F.col("g_class").alias("class")).agg(F.count("*").alias("support"))
    seen = truth.unionByName(joined.where("e_class IS NOT NULL").select(F.col("e_class").alias("class"), F.lit(0).cast("long").alias("support")).distinct()).groupBy("class").agg(F.sum("support").alias("support"))
    axis = seen.withColumn("k", F.explode(F.array(*map(F.lit, top_k))))
    rows = axis.join(by, ["class", "k"], "left")
    every = rows.groupBy("k").agg(*(F.sum(c).alias(c) for c in (*sums, "objects", "support")))
    every = every.withColumn("class", F.lit(None).cast(rows.schema["class"].dataType))
    mean = lambda c: F.try_divide(F.col(c), F.col("objects")).alias(c)
    return rows.unionByName(every.select(*rows.columns)).select("class", F.col("k").cast("int").alias("k"), mean("ade"), mean("fde"), F.try_divide("misses", "steps").alias("miss_rate"), "support")
