"""Ordinal quality classifier: cumulative logits over hashed text.

With grades 0..K-1, one weight vector w shared by all grades and ordered thresholds t,
P(grade <= k) = logistic(t_k - w.x).  x holds the presence of hashed words and punctuation runs and
binned shares (capitals, punctuation, distinct words, words said twice).  The model is fitted on the driver on a bounded
sample of graded rows; scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightline.llm.common import NO_LETTER, NO_MARK, Words, chunks, pack, unpack

BITS = 18
#: Graded documents used for the fit at most, those with the smallest hashes.
SAMPLE = 12_000
BINS = 12


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, sorted and distinct."""
    size = np.uint64(1 << BITS)
    words, marks = Words(texts, lower=True, space=NO_LETTER), Words(texts, space=NO_MARK)
    pairs = [w.row.astype(np.uint64) << np.uint64(32) | (w.hash[0] ^ np.uint64(salt)) % size for salt, w in ((0, words), (1, marks))]
    rows = np.arange(len(texts))
    data, letters = Words(texts, space=NO_LETTER).data, np.maximum(1, np.bincount(words.row, words.end - words.start, len(texts)))
    capital = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    capital = (capital[words.offs[1:]] - capital[words.offs[:-1]]) / letters
    count = np.maximum(1, words.counts())
    distinct = np.bincount(np.unique(words.row.astype(np.uint64) << np.uint64(44) | words.hash[0] >> np.uint64(20)) >> np.uint64(44), minlength=len(texts)) / count
    each = marks.counts() / count
    again = np.concatenate([[False], (words.hash[0][1:] == words.hash[0][:-1]) & (words.row[1:] == words.row[:-1])])[: len(words.row)]
    again = np.bincount(words.row[again], minlength=len(texts)) / count
    for k, x in enumerate((capital, np.minimum(each, 1), distinct + np.minimum(7, np.log2(count).astype(int)), again)):
        shape = (np.uint64(1 + k) << np.uint64(12)) + (np.asarray(x) * BINS).astype(np.uint64)
        pairs.append(rows.astype(np.uint64) << np.uint64(32) | (shape * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
    got = np.unique(np.concatenate(pairs))
    return (got >> np.uint64(32)).astype(np.int64), (got & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """A fitted model: ``index`` and ``weight`` of the features kept, thresholds between grades."""

    index: np.ndarray
    weight: np.ndarray
    cuts: np.ndarray

    @staticmethod
    def fit(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, grades: int, steps: int = 800, l2: float = 1e-4, features: int = 1024, least_z: float = 3.0, least_rows: int = 8) -> Ordinal:
        """Keeps the ``features`` hashes whose rows' mean grade differs most, by ``least_z`` standard errors over ``least_rows`` rows at least."""
        n = len(grade)
        share = np.cumsum(np.bincount(grade, minlength=grades) + 0.5)[:-1] / (n + 0.5 * grades)
        cuts = np.log(share / (1 - share))
        seen = np.bincount(cols, minlength=1 << BITS)
        mean = np.bincount(cols, grade[rows], 1 << BITS) / np.maximum(1, seen)
        z = np.abs(mean - grade.mean()) * np.sqrt(seen) / max(grade.std(), 1e-9)
        z[seen < least_rows] = 0
        index = np.sort(np.argsort(-z, kind="stable")[:features])
        index = index[z[index] >= least_z]
        place = np.full(1 << BITS, -1)
        place[index] = np.arange(len(index))
        x = np.zeros((n, len(index)), np.float32)
        hit = place[cols] >= 0
        x[rows[hit], place[cols[hit]]] = 1
        p = np.concatenate([np.zeros(len(index)), [cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-3))])
        m = v = np.zeros_like(p)
        for step in range(1, steps + 1):  # Adam; thresholds stay ordered as sums of exponentials
            cuts = Ordinal._cuts(p[len(index) :])
            score = x @ p[: len(index)].astype(np.float32)
            low = np.concatenate([[-np.inf], cuts])[grade] - score
            high = np.concatenate([cuts, [np.inf]])[grade] - score
            a, b = _logistic(low), _logistic(high)
            a[np.isneginf(low)], b[np.isposinf(high)] = 0, 1
            like = np.maximum(b - a, 1e-12)
            da, db = a * (1 - a) / like / n, b * (1 - b) / like / n
            gw = x.T @ (db - da).astype(np.float32) + l2 * p[: len(index)]
            gc = np.zeros(grades - 1)
            np.add.at(gc, np.minimum(grade, grades - 2), np.where(grade < grades - 1, -db, 0))
            np.add.at(gc, np.maximum(grade - 1, 0), np.where(grade > 0, da, 0))
            back = np.cumsum(gc[::-1])[::-1]
            g = np.concatenate([gw, back[:1], back[1:] * np.exp(p[len(index) + 1 :])])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return Ordinal(index, p[: len(index)], Ordinal._cuts(p[len(index) :]))

    @staticmethod
    def _cuts(p: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([p[:1], np.exp(p[1:])]))

    def predict(self, rows: np.ndarray, cols: np.ndarray, n: int, tail: int) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, P(grade >= tail)) of ``n`` rows."""
        weight = np.zeros(1 << BITS)
        weight[self.index] = self.weight
        above = 1 - _logistic(self.cuts - np.bincount(rows, weight[cols], n)[:, None])
        return above.sum(1), above[:, tail - 1] if tail else np.ones(n)


def fit_quality(docs: DataFrame, grades: DataFrame, levels: int = 3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", **options) -> Ordinal | None:
    """A model from ``grades(id_col, grade)``; None without graded rows.

    Learns from ``sample`` graded documents at most, those with the smallest hashes of their ids, in
    the order of these, so that a fit on the same rows gives the same model.  A document graded several
    times counts once, with its lowest grade; rows that repeat an id count once, with their smallest
    text; null ids and grades do not count; grades outside 0..levels-1 count as the nearest.
    ``options`` are those of :meth:`Ordinal.fit`.
    """
    grades = grades.where(F.col("grade").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("grade").cast("int").alias("grade"))
    chosen = grades.withColumn("place", F.xxhash64(id_col)).orderBy("place", id_col).limit(sample)
    rows = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).join(chosen, id_col).groupBy(id_col, "place", "grade").agg(F.min("text").alias("text")).select("place", "text", "grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                at, cols = features(part.column("text"))
                cut = np.searchsorted(at, np.arange(part.num_rows + 1))
                blobs = [pack(cols[i:j].astype(np.uint32)) for i, j in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([part.column("place"), part.column("grade"), pa.array(blobs, pa.binary())], ["place", "grade", "x"])

    got = rows.mapInArrow(run, "place long, grade int, x binary").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("place", "ascending"), ("grade", "ascending")])
    xs, grade = [unpack(b, np.uint32) for b in got.column("x").to_pylist()], np.clip(np.asarray(got.column("grade")), 0, levels - 1)
    return Ordinal.fit(np.repeat(np.arange(len(xs)), [len(x) for x in xs]), np.concatenate(xs).astype(np.int64), grade, levels, **options)


def score_quality(docs: DataFrame, model: Ordinal | None, tail: int = 2, keep_at: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` with expected_grade, p_tail = P(grade >= tail) and keep = p_tail >= ``keep_at``.

    Null and empty texts get the grade of a text without words.  Without a model the grades are null
    and every row is kept.  Input columns with the names of the results are replaced; rows are scored
    one by one, so repeated rows get equal results.
    """
    docs = docs.drop("expected_grade", "p_tail", "keep")
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(None).cast("double"), "p_tail": F.lit(None).cast("double"), "keep": F.lit(True)})
    schema = StructType(docs.schema.fields[:]).add("expected_grade", "double").add("p_tail", "double").add("keep", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                mean, p = model.predict(*features(part.column(text_col)), part.num_rows, tail)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(mean), pa.array(p), pa.array(p >= keep_at)], [*part.schema.names, "expected_grade", "p_tail", "keep"])

    return docs.mapInArrow(run, schema)


def graded(labels: DataFrame) -> DataFrame:
    """Grades of ``labels(doc_id, quality, toxic)``: 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))
