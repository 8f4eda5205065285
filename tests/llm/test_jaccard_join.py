import random

import pytest
from pyspark.sql import functions as F

from helpers import HAS_SF, SF
from sightline.llm.jaccard_join import jaccard_components
from sightline.llm.queries import op7_jaccard_join


def sets_of(rows, n):
    out = {}
    for d, t in rows:
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split()
        out[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    return out


def brute(rows, n, num, den):
    sets = sets_of(rows, n)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = sorted((d for d in sets if sets[d]), key=lambda d: len(sets[d]))
    for i, a in enumerate(by):
        for b in by[i + 1 :]:
            if len(sets[a]) * den < num * len(sets[b]):
                break
            c = len(sets[a] & sets[b])
            if c * den >= num * (len(sets[a]) + len(sets[b]) - c):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d)) for d in sets)


@pytest.mark.parametrize("words,num", [(4, 85), (5, 80)])
def test_random(spark, words, num):
    rng = random.Random(words)
    vocab = [f"W{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE two"), (905, "one"), (906, "one two three four"), (907, "x " * 3000), (908, "x " * 50)]
    d = 0
    for g in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randrange(3, 150))] + (passage if g % 2 else [])
        for _ in range(rng.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.randrange(0, 7)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            d += 1
            rows.append((d * 7 % 613, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).repartition(5)
    got = sorted(map(tuple, jaccard_components(df, words, num, 100).collect()))
    assert got == brute(rows, words, num, 100)


def brute_rows(rows, n, num, den):
    """Components where an id may have several texts: each is a set of the id's node."""
    texts = [(f"{k}", t) for k, (_, t) in enumerate(rows)]
    group = {d: c for d, _, c in brute(texts, n, num, den)}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    first = {}
    for k, (d, _) in enumerate(rows):
        a, b = find(d), find(rows[int(first.setdefault(group[str(k)], str(k)))][0])
        root[max(a, b)] = min(a, b)
    return sorted((d, find(d)) for d, _ in rows)


@pytest.mark.parametrize("gather", [4, 1 << 15])
def test_repeated_ids_and_dealt_tokens(spark, gather):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(1, "a b c d e f g h i j"), (3, "k l m n o p q r s t"), (3, "a b c d e f g h i j k"), (4, "k l m n o p q r s t u")]
    for g in range(4):
        base = [rng.choice(vocab) for _ in range(40)]
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((rng.randrange(10, 400), " ".join(w)))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 4, 80, 100, gather=gather).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == brute_rows(rows, 4, 80, 100)


def test_hashes_of_words_that_a_wrapping_sum_confuses():
    import pyarrow as pa

    from sightline.llm.common import Words

    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    w = Words(pa.array([one, two]), families=2)
    assert w.hash[0][0] != w.hash[0][1] and w.hash[1][0] == w.hash[1][1]


def test_no_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert jaccard_components(df.limit(0)).collect() == []
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_components(df).collect()) == [(0, 0), (1, 1), (1, 1)]


@pytest.mark.skipif(not HAS_SF, reason="needs the generated tables")
def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, op7_jaccard_join(spark, SF).collect())) == brute(list(map(tuple, docs)), 4, 85, 100)
