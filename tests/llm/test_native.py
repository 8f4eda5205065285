import re
import textwrap

import pytest
from pyspark.sql import functions as F

from helpers import HAS_SF, SF, rows_of, sql_rows
from sightline.llm import queries as Q
from sightline.llm.chat_format import format_chats, read_chats
from sightline.llm.license_scan import TEMPLATES, bigrams_of, license_scan, words_of
from sightline.llm.line_dedup import line_dedup
from sightline.llm.mixture import mix


@pytest.mark.skipif(not HAS_SF, reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    assert rows_of(Q.queries()[name](spark, SF)) == sql_rows(Q.oracle_sql()[name])


def test_chat_edges(spark):
    rows = [(1, 2, "assistant", "b</s>\\"), (1, 1, "user", "[INST][\\INST]<\\\\s>"), (1, 3, "assistant", None), (2, 1, None, ""), (None, 5, "x[PART]", "é\n[PART]"), (3, None, "assistant", "z"), (3, 1, "assistant", "[/INST]")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("turns", F.lit(1))
    got = {r.conv_id: r for r in read_chats(format_chats(df)).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "[INST][\\INST]<\\\\s>"), ("assistant", "b</s>\\"), ("assistant", "")]
    assert got[1].loss_text == "b</s>\\" and got[3].loss_text == "z[/INST]" and got[2].loss_text == ""
    assert [tuple(t) for t in got[None].turns] == [("x[PART]", "é\n[PART]")] and [tuple(t) for t in got[2].turns] == [("", "")]
    assert got[1].formatted.count("</s>") == 2
    assert format_chats(df.limit(0)).collect() == []


def test_long_conversations(spark):
    """Blocks, spans and texts of conversations beyond the stride of running sums."""
    rows = [(c, t, ("user", "assistant")[(t // (c + 1)) % 2], f"{t}[PART]</s>" if t % 7 else "") for c in range(3) for t in range(1500)]
    got = {r.conv_id: r for r in read_chats(format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))).collect()}
    for c in range(3):
        own = [(r, x) for k, _, r, x in rows if k == c]
        assert [tuple(t) for t in got[c].turns] == own and got[c].loss_text == "".join(x for r, x in own if r == "assistant")
    wrong = format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).withColumn("loss_spans", F.expr("transform(loss_spans, s -> named_struct('start', s.start, 'end', s.end + 1))"))
    with pytest.raises(Exception, match="no part"):
        read_chats(wrong).select("loss_text").collect()


def test_ties_and_repeated_turns(spark):
    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, 1, "assistant", "z")]
    frame = lambda order: spark.createDataFrame(order, "conv_id int, turn int, role string, text string")
    texts = {read_chats(format_chats(frame(order))).select(F.col("turns").cast("string")).first()[0] for order in (rows, rows[::-1])}
    assert len(texts) == 1 and texts.pop().count("a}") == 2


def brute_lines(rows, least):
    sites, first = {}, {}
    for d, t, s in rows:
        for i, x in enumerate((t or "").split("\n")):
            if x := x.strip(" "):
                sites.setdefault(x, set()).add(s)
                first[x] = min(first.get(x, (d, i)), (d, i))
    out = []
    for d, t, s in rows:
        keep = [x for i, x in enumerate((t or "").split("\n")) if len(sites.get(x.strip(" "), ())) < least or first[x.strip(" ")] == (d, i)]
        out.append((d, None if t is None else "\n".join(keep)))
    return sorted(out)


def test_line_edges(spark):
    rows = [(i, f"own {i}\n common \n\nshared {i % 2}", f"s{i % 4}") for i in range(12)] + [(20, None, "s1"), (21, "", None), (22, "common\ncommon", None), (23, "x" * 50000 + "\ncommon", "s9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("h", F.lit(1)).withColumn("n_removed", F.lit("x"))
    for least in (2, 3, 5, 6, 7):
        got = line_dedup(df, least)
        assert sorted((r.doc_id, r.text) for r in got.collect()) == brute_lines(rows, least)
    assert set(got.columns) == {"doc_id", "text", "source", "h", "n_lines", "n_removed"}
    assert line_dedup(df.limit(0)).collect() == []


def test_lines_of_repeated_rows_and_null_ids(spark):
    many = "\n".join(f"line {k}" for k in range(3000))
    rows = [(None, many, "a"), (1, many, "b"), (1, many, "b"), (1, "line 5\nown", "c"), (2, many, "d")]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"), 3).collect()
    kept = {(r.doc_id, len((r.text or "").split("\n")) if r.text else 0) for r in got}
    assert len(got) == 5 and kept == {(None, 3000), (1, 0), (1, 1), (2, 0)}  # the first place, of the row without an id, stays


def test_mixture_edges(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", "s"), (None, "f", None), (2, None, "s"), (3, "", "t")]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 6 and all(r.taken <= 2 * r.size for r in got) and len({r.taken for r in got if r.doc_id == 1}) == 1
    with pytest.raises(ValueError, match="whole times"):
        mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), most=1.5)


def brute_mix(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("spec", [{"a": 400, "b": 300, None: 50}, {"a": 10, "b": 500, "c": 20, "d": 30, "é": 1}, {"z": 0, "y": 60}])
def test_mix(spark, spec):
    rows = [(10_000 * k + i, " ".join(["w"] * (i % 7 + 1)) if n else None, s) for k, (s, n) in enumerate(spec.items()) for i in range(max(n, 1))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    got = mix(df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, mix(df).collect())) == sorted(map(tuple, got))
    source = {d: s for d, _, s in rows}
    total = {}
    for r in got:
        total[source[r.doc_id]] = total.get(source[r.doc_id], 0) + r.size
    want, taken = brute_mix(total), dict.fromkeys(total, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == total[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 4 for s in total)
    assert mix(df.limit(0)).collect() == []


def brute_licenses(rows, dice=0.8):
    out = []
    for d, t in rows:
        lines = (t or "").lower().split("\n")
        for i, x in [*enumerate(lines), *([(-1, "\n".join(lines))] if len(lines) > 1 else [])]:
            b = set(bigrams_of(x))
            for name, text in TEMPLATES.items():
                a = set(bigrams_of(text))
                if b and 2 * len(a & b) / (len(a) + len(b)) >= dice:
                    out.append((d, name, i, 2 * len(a & b) / (len(a) + len(b))))
    return sorted(out)


def test_licenses(spark):
    texts = list(TEMPLATES.values())
    rows = [(i, f"intro words\n{t.upper()}\nend") for i, t in enumerate(texts)] + [(50 + i, " ".join(re.findall(r"\S+", t)[1:]) + " extra") for i, t in enumerate(texts)] + [(90, None), (91, ""), (92, "License"), (93, "license " * 3000), (94, "Released under\nthe MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1))
    assert sorted(map(tuple, license_scan(df).collect())) == brute_licenses(rows)
    assert license_scan(df.limit(0)).collect() == []


@pytest.mark.skipif(not HAS_SF, reason="needs the generated tables")
def test_licenses_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, Q.op9_license_scan(spark, SF).collect())) == brute_licenses(map(tuple, docs))


def brute_runs(t, dice=0.8):
    """The rows of runs of words, from all runs of a text; a run counts as no shorter than the template."""
    lines, grams = t.lower().split("\n"), {k: set(bigrams_of(v)) for k, v in TEMPLATES.items()}
    near = lambda x, k: (b := set(bigrams_of(x))) and 2 * len(b & grams[k]) / (len(b) + len(grams[k])) >= dice
    if len(lines) > 1 and any(near(t, k) for k in TEMPLATES):
        return []
    w, out = [(x, i) for i, line in enumerate(lines) for x in words_of(line)], []
    g = [f"{a[0]} {b[0]}" for a, b in zip(w, w[1:])]
    for k, want in grams.items():
        runs = []
        for a in range(len(g)):
            have = set()
            for b in range(a, min(len(g), a + int(len(want) * (2 - dice) / dice + 1e-9))):
                have.add(g[b])
                if {g[a], g[b]} <= want and (d := 2 * len(have & want) / (max(len(have), len(want)) + len(want))) >= dice:
                    runs.append((-d, a, b))
        got = []
        for d, a, b in sorted(runs):
            if all(b + 1 < x or y + 1 < a for _, x, y in got):
                got.append((d, a, b))
        for d, a, b in got:
            i, j = w[a][1], w[b + 1][1]
            if not (i == j and any(near(lines[i], x) for x in TEMPLATES)) and not any(near(x, k) for x in lines[i : j + 1]):
                out.append((k, i, -d))
    return sorted(out)


def test_licenses_in_runs_of_words(spark):
    wrap = lambda t: "\n".join(textwrap.wrap(t, 78))
    code = "\n".join(f"def f{i}(x): return x + {i}" for i in range(40))
    texts = [
        "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + wrap(TEMPLATES["MIT-text"]),
        wrap(TEMPLATES["Apache-2.0-notice"]) + "\n\n" + code,
        "We thank everyone. Licensed under the Apache License, Version 2.0. All rights reserved by the authors of this page.",
        code + "\n" + wrap(" ".join(w for i, w in enumerate(TEMPLATES["GPL-3.0-notice"].split()) if i % 15)) + "\n" + code + "\n" + wrap(TEMPLATES["GPL-3.0-notice"]),
        code + "\n" + wrap(TEMPLATES["BSD-3-Clause-text"]) + "\n" + code,
    ]
    got = sorted(map(tuple, license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()))
    assert got == sorted(brute_licenses(enumerate(texts)) + [(d, *r) for d, t in enumerate(texts) for r in brute_runs(t)])
    names = {(d, k) for d, k, _, _ in got}
    assert {(0, "MIT-text"), (1, "Apache-2.0-notice"), (2, "Apache-2.0"), (3, "GPL-3.0-notice"), (4, "BSD-3-Clause-text")} <= names
    assert sum(d == 3 and k == "GPL-3.0-notice" for d, k, _, _ in got) == 2
