import hashlib
import os

import pytest

from sightline.llm.queries import op1_substring_dedup
from sightline.llm.substring_dedup import MAX_BUCKETS, FingerprintIndex, substring_dedup

SF = "/root/testdata/sf0.01"


def brute(rows, n=13):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), kept.decode()))
    return sorted(out)


def test_edges(spark):
    a = " ".join(f"w{i}" for i in range(40))
    rows = [(5, a), (2, "x " + " ".join(f"w{i}" for i in range(10, 30)) + "\ty"), (9, a), (9, a), (7, None), (8, ""), (1, "z"), (3, " ".join(["r"] * 60)), (-4, " ".join(["r"] * 13)), (11, "é b " + a), (12, " ".join(f"w{i}" for i in range(12)))]
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, n_words int, kept string")
    for batches in (1, 3, 5):
        got = sorted(tuple(r) for r in substring_dedup(df, batches=batches).collect())
        assert got == brute(rows)


def test_empty_and_null_id(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(none).collect() == []
    a = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, a), (None, a)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup(df).collect()) == [(0, 20), (1, 0)]


def test_an_index_goes_on_where_an_earlier_process_left_it(spark, tmp_path):
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    frame = lambda rows: spark.createDataFrame(rows, "doc long, text string")
    before, index = spark.conf.get(MAX_BUCKETS), FingerprintIndex(spark, path=f"file://{tmp_path}/index")
    index.add(frame([(1, words(0, 40))]))
    index.add(frame([(2, words(100, 140))]))
    index.close()
    assert spark.conf.get(MAX_BUCKETS) == before
    for start in (10, 110):  # a run of either batch, and after the second time a compacted one
        again = FingerprintIndex.open(spark, f"file://{tmp_path}/index")
        assert len(again.runs) >= 1
        docs = frame([(start + 1000, "new " + words(start, start + 20) + " end")])
        name = again.add(docs)
        got = again.clean(docs, [name]).collect()
        again.compact()
        again.close()
        assert [(r.n_removed, r.kept) for r in got] == [(20, "new end")]


def test_more_buckets_than_a_session_allows(spark):
    index = FingerprintIndex(spark, total_bytes=100 << 40)
    assert index.buckets > 100_000 and int(spark.conf.get(MAX_BUCKETS)) >= index.buckets
    index.close()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute([tuple(r) for r in docs])]
    assert sorted(tuple(r) for r in op1_substring_dedup(spark, SF).collect()) == want
