"""Boilerplate lines: removed where many sites carry them.

A sketch of the sites of each line is merged by aggregation; lines whose estimate lies near the
threshold are counted exactly.  Spark expressions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.chat_format import let
from sightline.llm.common import BROADCAST_KEYS, Scratch

#: Tasks that share the places of one line where the removed lines are too many to broadcast.
SALTS = 16


def spread_lines(lines: DataFrame, scratch: Scratch, min_sites: int, margin: float) -> DataFrame:
    """(h, first): hashes of lines on ``min_sites`` sites or more, with their first place."""
    each = lines.groupBy("h").agg(F.hll_sketch_agg("site").alias("sites"), F.min("place").alias("first"))
    each = each.select("h", "first", F.hll_sketch_estimate("sites").alias("about"))
    wide = max(1.0, margin * min_sites)
    each = scratch.put(each.where(F.col("about") >= min_sites - wide), "candidates")
    near = each.where(F.col("about") <= min_sites + wide)
    exact = lines.join(near.select("h"), "h", "left_semi").select("h", "site").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    sure = each.where(F.col("about") > min_sites + wide)
    return sure.select("h", "first").unionByName(near.join(exact, "h", "left_semi").select("h", "first"))


def line_dedup(docs: DataFrame, min_sites: int = 10, margin: float = 0.2, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """All columns of ``docs``, the text without boilerplate, and n_lines, n_removed.

    A line is what stands between line feeds, without surrounding spaces.  It is boilerplate if
    ``min_sites`` different sites carry it; then only its first place, by id and line number, stays.
    Blank lines are never counted or removed.  Estimates within ``margin`` of the threshold are
    counted exactly.

    Texts take time in proportion to their lines, however many of these go.

    A null site is a site of its own; null ids come first; null text stays null (0 lines).  Rows
    repeated with id and text count as one place, and each keeps it.  Input columns named n_lines or
    n_removed are replaced; an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    base = docs.drop("n_lines", "n_removed")
    text, key = F.col(text_col), F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"))
    # Texts are cut before they are exploded: what is computed beside a generator is computed for each line.
    cut = docs.select(key.alias("doc"), F.coalesce(F.concat(F.lit("="), F.col(site_col)), F.lit("")).alias("site"), F.split(text, "\n", -1).alias("lines"))
    lines = cut.select("doc", "site", F.posexplode("lines").alias("pos", "line"))
    lines = lines.select("doc", "site", "pos", F.trim("line").alias("line")).where("line <> ''")
    lines = lines.select("site", F.xxhash64("line").alias("h"), F.struct("doc.id", "pos", "doc.t").alias("place"))
    spread = scratch.put(spread_lines(lines, scratch, min_sites, margin), "spread")
    if spread.count() <= BROADCAST_KEYS:
        found = lines.join(F.broadcast(spread), "h")
    else:  # a hot line is dealt to SALTS tasks
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        found = lines.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(SALTS)).cast("int")).join(spread.withColumn("salt", salts), ["h", "salt"])
    gone = found.where("NOT (place <=> first)")
    gone = gone.groupBy(F.col("place.id").alias("gone_id"), F.col("place.t").alias("gone_t")).agg(F.collect_set("place.pos").alias("gone"))
    out = base.withColumn("t", F.xxhash64(text_col)).join(gone, F.expr(f"`{id_col}` <=> gone_id AND t = gone_t"), "left")
    parts = F.split(text, "\n", -1)
    left = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("gone"))
    kept = let(parts, lambda p: F.array_join(F.transform(left(p), lambda i: F.get(p, i)), "\n"))
    cleaned = F.when(F.col("gone").isNull(), text).otherwise(kept)
    return out.select(
        *(cleaned.alias(text_col) if c == text_col else F.col(c) for c in base.columns),
        F.coalesce(F.size(F.filter(parts, lambda x: F.trim(x) != "")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
