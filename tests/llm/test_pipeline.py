import pytest

import corpus_pipeline as P
from helpers import HAS_SF, SF
from test_jaccard_join import brute
from test_native import brute_lines


@pytest.mark.skipif(not HAS_SF, reason="needs the generated tables")
def test_stages(spark, tmp_path):
    assert [n for n, _ in P.STAGES] == ["quality", "line dedup", "near duplicates", "decontamination", "mixture"]
    docs, tables = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        tables.append({r.doc_id: r for r in docs.collect()})
    all_ = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [d for d, r in labels.items() if r.quality == 1 and r.toxic == 0]
    toxic = [d for d, r in labels.items() if r.toxic == 1]
    assert sum(d in tables[0] for d in clean) > 0.97 * len(clean) and sum(d in tables[0] for d in toxic) < 0.35 * len(toxic)  # 51 toxic documents to learn from
    lines = {d: t for d, t in brute_lines([(r.doc_id, r.text, r.source) for r in tables[0].values()], 10)}
    assert {d: r.text for d, r in tables[1].items()} == {d: t for d, t in lines.items() if t.strip(" ") or t == tables[0][d].text}
    groups = brute([(r.doc_id, r.text) for r in tables[1].values()], 5, 80, 100)
    assert set(tables[2]) == {d for d, _, c in groups if c == d}
    assert set(tables[3]) <= set(tables[2]) and all(tables[3][d] == tables[2][d] for d in tables[3])
    sizes = {d: len(r.text.encode().split()) for d, r in tables[3].items()}
    assert all(r.size == sizes[d] and 0 < r.taken <= 2 * r.size for d, r in tables[4].items())
    assert abs(sum(r.taken for r in tables[4].values()) / (1.5 * sum(sizes.values())) - 1) < 0.1 and set(all_) > set(tables[4])


def test_rows_without_an_id_and_rows_that_share_one(spark, tmp_path):
    words = lambda a, n=40: " ".join(f"w{a}x{k}" for k in range(n))
    item = " ".join(f"item{k}" for k in range(20))
    rows = [(1, words(1)), (None, words(1)), (None, words(2)), (None, words(2)), (5, words(3)), (5, words(4)), (6, words(4) + " more"), (7, words(7)), (7, words(7)), (8, None), (8, None), (9, ""), (None, words(8) + " " + item), (10, words(9) + " " + item)]
    docs = spark.createDataFrame([(d, t, "en", f"s{k % 3}", len(t or "")) for k, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    of = lambda frame: sorted(((r.doc_id or -1, r.text) for r in frame.collect()), key=str)
    assert of(P.quality(spark, docs, str(tmp_path))) == of(docs) == of(P.boilerplate(spark, docs, str(tmp_path)))
    near = P.near_duplicates(spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    assert of(near) == sorted([(1, words(1)), (-1, words(2)), (5, words(3)), (5, words(4)), (7, words(7)), (8, None), (9, ""), (-1, words(8) + " " + item), (10, words(9) + " " + item)], key=str)
    clean = P.leaks(spark, near, str(tmp_path))
    assert of(clean) == [r for r in of(near) if item not in (r[1] or "")] and clean.columns == docs.columns
    mixed = P.mixture(spark, docs, str(tmp_path)).collect()
    assert all(0 < r.taken <= 2 * r.size for r in mixed) and {r.doc_id for r in mixed} <= {d for d, t in rows if t}
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
