"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

All n-grams of test items are seeds: those that an edited copy keeps are not known to be rare.
A document that has several seeds of an item near one diagonal is aligned with the item there; the
local score, over that of a perfect copy, tells edited copies from chance.  The benchmark is sent to
the tasks in blocks of bounded size, so a larger one costs more passes, not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import NO_LETTER, Words, chunks, runs_of

#: Test items sent to the tasks at once.
BLOCK = 20_000
#: Seed hits looked at in one go (or one document's), so that common seeds do not cost memory.
HITS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1


def _words(texts: pa.Array) -> Words:
    return Words(pc.utf8_lower(texts), space=NO_LETTER)


@dataclass
class Items:
    """A block of test items: their words, and n-grams as (hash, item, place), sorted by hash."""

    ids: list
    words: list[np.ndarray]
    gram: np.ndarray
    item: np.ndarray
    place: np.ndarray
    short: dict[int, dict[int, list[int]]]

    @staticmethod
    def of(rows: list[tuple], n: int, least: int) -> Items:
        w = _words(pa.array([t or "" for _, t in rows], pa.string()))
        cut, (at, h) = w.bounds(), w.ngrams(n)
        short: dict[int, dict[int, list[int]]] = {}
        for k, m in enumerate(np.diff(cut)):
            if 0 < m < least:
                short.setdefault(int(m), {}).setdefault(int(w.whole(k)[0]), []).append(k)
        enough = (np.diff(cut) >= least)[w.row[at]]
        at, h = at[enough], h[enough]
        order = np.argsort(h, kind="stable")
        item = w.row[at][order]
        return Items([i for i, _ in rows], [w.hash[0][i:j] for i, j in zip(cut, cut[1:])], h[order], item, at[order] - cut[item], short)


def align(docs: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of pairs of word sequences, all pairs at once along anti-diagonals."""
    a, b = max(map(len, items)), max(map(len, docs))
    x, y = np.zeros((len(items), a), np.uint64), np.ones((len(docs), b), np.uint64)
    for k, (i, d) in enumerate(zip(items, docs)):
        x[k, : len(i)], y[k, : len(d)] = i | np.uint64(2), d | np.uint64(2)  # neither equals what fills up the ends
    before = last = np.zeros((len(items), a + 1), np.int32)
    best = np.zeros(len(items), np.int32)
    for s in range(a + b - 1):
        lo, hi = max(0, s - b + 1), min(a, s + 1)
        rows = np.arange(lo, hi)
        now = np.zeros_like(last)
        same = np.where(x[:, rows] == y[:, s - rows], MATCH, MISMATCH)
        cell = np.maximum(before[:, lo:hi] + same, np.maximum(last[:, lo:hi], last[:, lo + 1 : hi + 1]) + GAP)
        now[:, lo + 1 : hi + 1] = np.maximum(cell, 0)
        best = np.maximum(best, now.max(1))
        before, last = last, now
    return best


def _regions(row: np.ndarray, item: np.ndarray, diag: np.ndarray, place: np.ndarray, sizes: np.ndarray, need: np.ndarray):
    """(row, item, lowest, highest diagonal) of groups of seed hits that lie near each other, as many as their item needs."""
    if not len(row):
        return row, item, diag, diag
    order = np.lexsort((diag, item, row))
    row, item, diag, place = row[order], item[order], diag[order], place[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (diag[1:] - diag[:-1] > sizes[item[1:]] // 4 + 2)
    begin = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    first = runs_of(*(x[np.lexsort((place, group))] for x in (group, place)))
    distinct = np.bincount(group[np.lexsort((place, group))][first], minlength=len(begin))
    end = np.append(begin[1:], len(row))
    seeds = distinct >= need[item[begin]]
    return row[begin][seeds], item[begin][seeds], diag[begin][seeds], diag[end - 1][seeds]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 3, hits: int = 2, score: float = 0.6, least: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id_col, item_col, score): documents that hold a copy of a test item, edited or not.

    Words are lower-case runs of letters and digits.  An item's seeds are all its word ``n``-grams,
    common ones too.  ``hits`` different seeds near one diagonal start an alignment (match 2, mismatch
    and gap -1) over the item and as many words on either side; a document counts from ``score`` times
    a perfect copy's score on, and gets the best score of each item.  An item with fewer seeds than
    ``hits`` needs all of them; what one item needs does not depend on the others.  Items of fewer than
    ``least`` words count word for word only, those of fewer than ``n`` only as a whole text.

    The items are sent to the tasks, ``block`` at a time, and each document's n-grams are looked up
    there: a seed that is common in the corpus would otherwise shuffle all its places.  A copy with
    fewer than ``hits`` intact n-grams near one diagonal is not found.

    Null and empty texts match nothing; null ids are kept; rows with one id get one result an item,
    the best; other columns are ignored; empty tables give none.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    tests = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).cast("string").alias("t")).where("t IS NOT NULL").distinct()
    schema = f"id {id_type.simpleString()}, item {benchmark.schema[item_col].dataType.simpleString()}, score double"
    parts = max(1, -(-tests.count() // block))
    found = None
    for k in range(parts):
        rows = tests.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k) if parts > 1 else tests
        items = Items.of(sorted((tuple(r) for r in rows.collect()), key=lambda r: (r[0] is None, r)), n, least)
        if not len(items.gram) and not items.short:
            continue
        one = docs.mapInArrow(_search(items, n, hits, score, schema_of(id_type, items)), schema)
        found = one if found is None else found.unionAll(one)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.groupBy("id", "item").agg(F.max("score").alias("score")).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "score")


def schema_of(id_type, items: Items) -> pa.DataType:
    return pa.string() if any(isinstance(i, str) for i in items.ids) else pa.int64()


def _search(items: Items, n: int, hits: int, score: float, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(w) for w in items.words])
        many = np.append(runs_of(items.gram), len(items.gram))
        known, number = items.gram[many[:-1]], np.diff(many)
        need = np.minimum(hits, np.bincount(items.item, minlength=len(sizes)))  # each item by itself
        for batch in batches:
            for part in chunks(batch):
                w = _words(part.column("text"))
                cut, (at, h) = w.bounds(), w.ngrams(n)
                i = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                ok = np.flatnonzero(known[i] == h) if len(known) else i[:0]
                i, at = i[ok], at[ok]
                regions = [_regions(*hit, sizes, need) for hit in _hits(items, many, number, i, at, w.row, cut)]
                rows, its, best = [], [], []
                for r, t in _verbatim(w, items.short, n):
                    rows.append(r)
                    its.append(items.ids[t])
                    best.append(1.0)
                todo = [(r, t, c) for found in regions for r, t, lo, hi in zip(*found) for c in _windows(w.hash[0][cut[r] : cut[r + 1]], int(lo), int(hi), int(sizes[t]))]
                todo.sort(key=lambda x: sizes[x[1]])
                for j in range(0, len(todo), 256):
                    some = todo[j : j + 256]
                    got = align([c for _, _, c in some], [items.words[t] for _, t, _ in some]) / (MATCH * sizes[[t for _, t, _ in some]])
                    for (r, t, _), s in zip(some, got):
                        if s >= score:
                            rows.append(r)
                            its.append(items.ids[t])
                            best.append(float(s))
                if rows:
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(rows)), pa.array(its, item_type), pa.array(best)], ["id", "item", "score"])

    return run


def _verbatim(w: Words, short: dict[int, dict[int, list[int]]], n: int) -> Iterator[tuple[int, int]]:
    """(row, item) of short items word for word: anywhere, or as the whole text if they have fewer than ``n`` words."""
    cut = w.bounds()
    for size, by_hash in short.items():
        runs = w.runs(size)
        for k in np.flatnonzero(np.isin(runs[1], np.array(list(by_hash), np.uint64))):
            row = int(w.row[runs[0][k]])
            if size >= n or cut[row + 1] - cut[row] == size:
                for t in by_hash[int(runs[1][k])]:
                    yield row, t


def _hits(items: Items, many: np.ndarray, number: np.ndarray, i: np.ndarray, at: np.ndarray, row: np.ndarray, cut: np.ndarray) -> Iterator[tuple]:
    """(row, item, diagonal, place) of seed hits, some whole documents at a time."""
    total = np.append(0, np.cumsum(number[i]))
    ends = np.append(runs_of(row[at])[1:], len(at))
    j = 0
    while j < len(at):
        k = int(ends[max(np.searchsorted(ends, j, side="right"), np.searchsorted(total[ends], total[j] + HITS, side="right") - 1)])
        each = number[i[j:k]]
        which = np.repeat(many[i[j:k]], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        here = np.repeat(at[j:k], each)
        yield row[here], items.item[which], here - cut[row[here]] - items.place[which], items.place[which]
        j = k


def _windows(words: np.ndarray, lo: int, hi: int, size: int) -> Iterator[np.ndarray]:
    """The words around diagonals lo to hi, in overlapping pieces that hold any whole copy."""
    begin, end = max(0, lo - size // 2), min(len(words), hi + size + size // 2)
    while True:
        yield words[begin : min(end, begin + 5 * size)]
        if begin + 5 * size >= end:
            return
        begin += 3 * size
