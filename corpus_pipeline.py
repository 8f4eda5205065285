"""From raw documents to a training mix: five stages, each an operator over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again.  Rows are
told apart by id and text, so rows without an id, and rows that share one, are judged each by itself.
Every stage takes empty tables, null and empty texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.decontaminate import decontaminate
from sightline.llm.jaccard_join import jaccard_components
from sightline.llm.line_dedup import line_dedup
from sightline.llm.mixture import mix
from sightline.llm.quality import fit_quality, graded, score_quality
from sightline.sources.scratch import Scratch


def row_key() -> Column:
    """A number for id and text; exact repeats of a row share it."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled documents.

    A text without words is judged as such.  Repeated rows are judged alike; without labels all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, fit_quality(docs, graded(labels))).where("keep").select(*docs.columns)


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that many sources share; documents of nothing else go.

    Null and empty texts stay as they are.  Rows that repeat id and text keep a line at the same place.
    """
    out = line_dedup(docs).where("n_removed = 0 OR trim(text) <> ''")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles: the one with the smallest id.

    Rows without an id come after all others, ties go by a hash of the text.  Of rows that repeat id
    and text one stays, of rows that share an id but not the text each is judged by itself.  Null and
    empty texts are linked with nothing.
    """
    keyed = docs.withColumn("_key", row_key())
    groups = jaccard_components(keyed, id_col="_key").select("_key", F.col("component_id").alias("_group")).distinct()
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "_key")
    own = keyed.select("doc_id", "_key").distinct().join(groups, "_key")
    first = own.groupBy("_group").agg(F.min_by("_key", rank).alias("_key")).select("_key")
    kept = keyed.join(first, "_key", "left_semi")
    repeated = keyed.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key")
    once = kept.join(repeated, "_key", "left_anti").unionByName(kept.join(repeated, "_key", "left_semi").dropDuplicates(["_key"]))
    return once.select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; rows that share an id are judged each by itself."""
    keyed = docs.withColumn("_key", row_key())
    found = decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_key").select("_key").distinct()
    return keyed.join(found, "_key", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many words of each: once or twice its size.

    Rows that repeat id and text are taken together, each as often.  Texts without words are not taken.
    """
    keyed = docs.withColumn("_key", row_key())
    taken = mix(keyed, id_col="_key").where("taken > 0").select("_key", "size", "taken").dropDuplicates(["_key"])
    return keyed.join(taken, "_key").select(*docs.columns, "size", "taken")


STAGES = [("quality", quality), ("line dedup", boilerplate), ("near duplicates", near_duplicates), ("decontamination", leaks), ("mixture", mixture)]

#: The classifier and the alignment cannot be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), f"stage-{k}")
        if before:
            scratch.drop(before)
        before = f"stage-{k}"
    return docs
