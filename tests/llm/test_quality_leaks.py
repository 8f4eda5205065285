import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import HAS_SF
from sightline.llm.decontaminate import GAP, MATCH, MISMATCH, align, decontaminate
from sightline.llm.quality import Ordinal, fit_quality, graded, score_quality

BIG = "/root/testdata/sf0.1"


def plain(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1, j + 1] = max(0, h[i, j] + (MATCH if x == y else MISMATCH), h[i, j + 1] + GAP, h[i + 1, j] + GAP)
    return int(h.max())


def test_align():
    rng = random.Random(1)
    pairs = [([rng.randrange(9) * 4 + 100 for _ in range(rng.randrange(1, 30))], [rng.randrange(9) * 4 + 100 for _ in range(rng.randrange(1, 60))]) for _ in range(60)]
    got = align([np.array(d, np.uint64) for _, d in pairs], [np.array(i, np.uint64) for i, _ in pairs])
    assert got.tolist() == [plain(i, d) for i, d in pairs]


def test_leaks(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(900)]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    items = [(i, " ".join(text(30)).capitalize() + ".") for i in range(12)] + [(20, "too short"), (21, None), (22, ""), (23, "qqa qqb qqc qqd")]
    rows, want = [], set()
    for d in range(120):
        w = text(rng.randrange(0, 400))
        if d % 3 == 0:
            i = d // 3 % 12
            copy = items[i][1].upper().split()
            for k in range(d // 3 % 4):  # up to three edits
                copy[5 + 8 * k] = rng.choice(["edit", "edit more", ""])
            at = rng.randrange(len(w) + 1)
            w[at:at] = copy
            want.add((d, i))
        rows.append((d, " ".join(w) if d != 7 else None))
    rows += [(200, "too short"), (201, "this is too short a text"), (202, "x QQA qqb, qqc qqd y"), (203, "qqa qqb qqd")]
    want |= {(200, 20), (202, 23)}  # short items count word for word
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    tests = spark.createDataFrame(items, "item_id long, text string")
    for block in (100, 5):
        got = decontaminate(df, tests, block=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and all(0.6 <= r.score <= 1 for r in got)
    assert decontaminate(df, tests.limit(0)).collect() == [] and decontaminate(df.limit(0), tests).collect() == []


def test_ordinal():
    rng = np.random.default_rng(0)
    x, n = rng.random((3000, 40)) < 0.2, 3000
    score = x @ np.concatenate([[3, -3, 2], np.zeros(37)]) + rng.logistic(size=n)
    grade = np.searchsorted([-1.0, 2.0], score)
    r, c = np.nonzero(x)
    m = Ordinal.fit(r, c, grade, 3)
    mean, tail = m.predict(r, c, n, 2)
    assert m.cuts[0] < m.cuts[1] and np.corrcoef(mean, score)[0, 1] > 0.55 and abs(tail.mean() - (grade == 2).mean()) < 0.02


def test_quality_edges(spark):
    rows = [(i, f"good fine words {i}" if i % 2 else f"bad ugly junk!!! {i}") for i in range(200)] + [(500, None), (501, ""), (502, "good " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep", F.lit("x"))
    grades = spark.createDataFrame([(i, 2 * (i % 2)) for i in range(150)] + [(3, None), (None, 1), (999, 0)], "doc_id long, grade int")
    got = {r.doc_id: r for r in score_quality(df, fit_quality(df, grades)).collect()}
    assert len(got) == 203 and all(got[i].keep == bool(i % 2) for i in range(200)) and got[502].keep
    assert all(r.keep and r.p_tail is None for r in score_quality(df, fit_quality(df, grades.limit(0))).collect())
    assert score_quality(df.limit(0), fit_quality(df, grades)).collect() == []


@pytest.mark.skipif(not HAS_SF, reason="needs the generated tables")
def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text"), graded(spark.read.parquet(f"{BIG}/labels.parquet"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0
    model = fit_quality(docs, labels.where(~fold))
    got = score_quality(docs.join(labels.where(fold), "doc_id"), model).select("grade", "keep").toPandas()
    by = got.groupby("grade").keep.mean()
    print(by, len(got))
    assert by[0] < 0.05 and by[1] < 0.15 and by[2] > 0.98  # about 3000 graded rows to learn from


def test_leaks_with_every_fourth_word_replaced(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(900)]
    items = [(i, [rng.choice(vocab) for _ in range(k)]) for i, k in enumerate((15, 20, 30, 45, 59))]
    rows, want = [], set()
    for i, words in items:
        for d in (10 * i, 10 * i + 1):
            copy = ["edit" if k % 4 == 3 else x for k, x in enumerate(words)]
            rows.append((d, " ".join([rng.choice(vocab) for _ in range(40)] + copy + [rng.choice(vocab) for _ in range(40)])))
            assert plain(words, copy) >= 0.6 * MATCH * len(words)
            want.add((d, i))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    for block in (100, 2):
        assert {(r.doc_id, r.item_id) for r in decontaminate(df, tests, block=block).collect()} == want


def test_what_one_item_needs_does_not_depend_on_the_others(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    doc = spark.createDataFrame([(1, "alpha beta gamma x1 epsilon x2 eta x3")], "doc_id long, text string")
    one = [(1, item)]
    alone, beside = (decontaminate(doc, spark.createDataFrame(rows, "item_id long, text string"), score=0.3).collect() for rows in (one, [*one, (2, "too short"), (3, "one more")]))
    assert alone == beside


def test_recall_of_seeds(spark):
    """Copies with edits at random against an alignment of every document with every item."""
    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(500)]
    items = [(i, [rng.choice(vocab) for _ in range(rng.randrange(12, 50))]) for i in range(25)]
    rows = []
    for d in range(250):
        i, words = items[d % 25]
        copy = []
        for w in words:
            x, share = rng.random(), d / 250 * 0.4
            copy += [] if x < share / 3 else [w, rng.choice(vocab)] if x < 2 * share / 3 else [rng.choice(vocab)] if x < share else [w]
        rows.append((d, [rng.choice(vocab) for _ in range(rng.randrange(20))] + copy + [rng.choice(vocab) for _ in range(rng.randrange(20))]))
    truth = {(d, i) for d, text in rows for i, words in items if plain(words, text) >= 0.6 * MATCH * len(words)}
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate(spark.createDataFrame([(d, " ".join(t)) for d, t in rows], "doc_id long, text string"), tests).collect()}
    assert len(truth) > 100 and got <= truth and len(got) >= 0.9 * len(truth)


def test_null_and_repeated_ids(spark):
    item = " ".join(f"word{k}" for k in range(20))
    rows = [(None, f"x {item} y"), (5, f"x {item} y"), (5, f"x {item} y"), (5, "nothing"), (6, None), (7, ""), (8, "clean")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(0))
    got = decontaminate(df, spark.createDataFrame([(1, item), (1, item), (2, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.item_id, r.score) for r in got) == [(-1, 1, 1.0), (-1, 2, 1.0), (5, 1, 1.0), (5, 2, 1.0)]
    graded_ = spark.createDataFrame([(i, 2 * (i % 2)) for i in range(60)] * 2, "doc_id long, grade int")
    docs = spark.createDataFrame([(i, f"good fine {i}" if i % 2 else f"bad ugly {i}") for i in range(60)] * 3 + [(None, "good fine")], "doc_id long, text string")
    one, two = (fit_quality(docs.repartition(k), graded_.repartition(k + 1), sample=50) for k in (2, 7))
    assert (one.index == two.index).all() and (one.weight == two.weight).all() and (one.cuts == two.cuts).all()
    assert score_quality(docs, one).where("doc_id IS NULL").first().keep
