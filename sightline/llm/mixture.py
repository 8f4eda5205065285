"""Mixing sources to target weights by hash thresholds, without sorting documents.

Every document has a 60-bit hash.  Of each source the documents below a threshold are taken, so a
larger budget takes what a smaller one takes and more.  The threshold is found by histograms of
tokens by source and leading hash bits: the bucket in which the budget falls is cut again by the
next bits, and only its documents are read for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import BROADCAST_KEYS, Scratch

#: Hash bits of each histogram, from the leading ones; 60 in all.
LEVELS = (8, 8, 8, 8, 8, 8, 8, 4)
BITS = sum(LEVELS)
WORDS = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """(source, source_size, target) by repeated sharing: min(most * size, level * weight).

    Sources have one row each here, so the windows over all of them are small.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(every) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    rows = rows.withColumn("cap", F.col("source_size") * float(most)).withColumn("at", F.col("cap") / F.col("weight"))
    all_, order = Window.partitionBy(), Window.orderBy("at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    capped, open_ = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.lit(float(budget)) * F.sum("source_size").over(all_) - capped) / open_
    rows = rows.withColumn("level", level)
    # the sources are filled in the order of cap / weight; the first that stays below its cap sets the level
    first = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", F.col("level").alias("level")))).over(all_)
    rows = rows.withColumn("first", first.getField("level"))
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("first") * F.col("weight"), F.col("cap"))).alias("target"))


def hash_of(seed: int, *columns: Column) -> Column:
    """60 bits of the MD5 of a seed and some values; null and empty values differ."""
    text = F.concat(F.lit(str(seed)), *(F.coalesce(F.concat(F.lit("|="), c.cast("string")), F.lit("|")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def small(rows: DataFrame, count: int) -> DataFrame:
    """Rows for a join: broadcast where there are few."""
    return F.broadcast(rows) if count <= BROADCAST_KEYS else rows


def _thresholds(docs: DataFrame, goals: DataFrame, sources: int, scratch: Scratch) -> DataFrame:
    """(source, bound, last): documents with a hash below ``bound`` count once more, and one at it if ``last``.

    After each level only the documents of the boundary buckets are kept for the next one.
    """
    state = goals.select("source", F.lit(0).cast("long").alias("bound"), F.col("goal").alias("left"))
    low, docs = BITS, docs.select("source", "hash", "size")
    for level, bits in enumerate(LEVELS):
        low -= bits
        hist = docs.groupBy("source", F.expr(f"shiftright(hash, {low})").alias("bucket")).agg(F.sum("size").alias("tokens"))
        hist = hist.join(small(state.select(F.col("source").alias("s"), "left"), sources), F.expr("source <=> s"))
        cum = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket")) - F.col("tokens")
        inside = hist.withColumn("before", cum).where("before <= left")
        state = inside.groupBy("source").agg(F.max("bucket").alias("bound"), F.max_by(F.col("left") - F.col("before"), "bucket").alias("left"), F.max_by("tokens", "bucket").alias("tokens"))
        state = scratch.put(state, f"state-{level}")
        if low:
            same = docs.alias("d").join(small(state.alias("s"), sources), F.expr(f"d.source <=> s.source AND shiftright(d.hash, {low}) = s.bound"), "left_semi")
            docs = scratch.put(same, f"boundary-{level}")
    return state.select("source", "bound", (F.col("left") * 2 >= F.col("tokens")).alias("last"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """(id_col, size, source_size, target, taken): how many words of each document the mix takes.

    Sources in code point order (null last) weigh ``weights``, repeating, and share ``budget`` times
    all words; a target stops at ``most`` times its source's size and the excess is shared again by
    weight.  A document is taken 0 to ``most`` times; which ones are taken once more follows from
    their hash alone, so reruns agree.  A source's sum is off by half a document at most.

    ``most`` is a whole number, as documents are taken whole times.  Null or empty text: size 0.
    Null ids are hashed by their text.  Rows that repeat id and text have one hash and are taken
    together.  Only the three named columns are read; an empty table gives none.  A source has one
    row in the plan, broadcast where these are few and joined otherwise; the plan itself is made in
    one task.
    """
    if most != int(most) or most < 1:
        raise ValueError(f"documents are taken whole times, not {most}")
    scratch = Scratch(docs.sparkSession, "mixture")
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), hash_of(seed, F.col(id_col), F.col(text_col)).alias("hash"))
    sizes = scratch.put(sizes, "sizes")
    goals = scratch.put(targets(sizes, weights, budget, most), "targets")
    sources = goals.count()
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("base", whole).withColumn("goal", F.col("target") - F.col("base") * F.col("source_size"))
    cut = scratch.put(_thresholds(sizes.where("size > 0"), goals, sources, scratch), "thresholds").withColumnRenamed("source", "cut_source")
    plan = scratch.put(goals.join(cut, F.expr("source <=> cut_source"), "left").drop("cut_source").withColumnRenamed("source", "plan_source"), "plan")
    again = F.coalesce((F.col("hash") < F.col("bound")) | ((F.col("hash") == F.col("bound")) & F.col("last")), F.lit(False))
    taken = (F.col("size") * (F.col("base") + again.cast("long"))).cast("long")
    out = sizes.join(small(plan, sources), F.expr("source <=> plan_source"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))
