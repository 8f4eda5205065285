"""Jaccard join on word n-grams: who is linked with whom, directly or through others.

Two sets with Jaccard similarity t or more share a token among the first |x| - ceil(t |x|) + 1 of
each, in any order common to all.  Rarer tokens come first, by a count sketch of fixed size over all
documents, so what very many documents share is not used to find partners.

1. Equal sets become one class, the smallest id stands for it.
2. Prefix tokens are dealt to buckets.  A token's sets in one size band and the next are a tile.
3. Tiles are worked off in rounds, so that groups of copies need not be compared pair by pair: in the
   first rounds a tile's leaders are paired with the sets not joined to them yet, in the last one all
   that is still open; large tiles are cut into parts.  The first leader is the smallest set, later
   ones have most links so far: copies edited each in its own way are often linked only through the
   middle of their group.  A pair is looked at where its first shared token may be: so many of either
   set's tokens must be left from there on.  Bit counts of hashed bitmaps bound the overlap from
   above; what passes is intersected exactly, as sorted arrays.

No pair that could be linked is left out: each is joined in some round or tested in the last one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import BROADCAST_KEYS, Scratch, Words, chunks, components, in_files, mix, pack, power_of_two, runs_of, small_batches, tidy, unpack, unpack_all

#: Counters of the sketch, which grows with the corpus between these bounds; part size when it is summed.
SKETCH, SKETCH_MOST, SKETCH_PART = 1 << 18, 1 << 22, 4096
#: Sets of a tile that is not cut; sets of a token that one task gathers, about.
TILE, GATHER = 1024, 1 << 15
FLUSH = 1_000_000
#: Rounds after the first leaders: the last one tests all that is left, the others only save it work.
ROUNDS = 3
#: Leaders of a tile in each of these rounds: a set may fit one and not be linked with it.
LEADERS = 8


def token_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's n-grams; of a shorter text the whole sequence."""
    w = Words(texts, lower=True)
    at, h = w.ngrams(n)
    cut, words = w.bounds(at), w.bounds()
    for k in range(w.rows):
        i, j = words[k], words[k + 1]
        yield w.whole(k) if 0 < j - i < n else np.unique(h[cut[k] : cut[k + 1]])


def digest(tokens: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the tokens by hashed bit; four to eight bits a token, so that few of them coincide."""
    bits = power_of_two(4 * len(tokens), 64, 1 << 17)
    return np.packbits(np.bincount((tokens >> np.uint64(20)) & np.uint64(bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def fold(maps: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of bytes) of half as many bits, as often as needed."""
    while maps.shape[1] > size:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def may_link(n_a, n_b, maps_a, maps_b, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes and bitmaps can be linked: overlap <= (n_a + n_b - differing bits) / 2."""
    size = min(maps_a.shape[-1], maps_b.shape[-1])
    a, b = (np.ascontiguousarray(fold(m, size)).view(np.uint64) for m in (maps_a, maps_b))
    differ = np.bitwise_count(a ^ b).sum(-1).astype(np.int64)
    return 2 * num * (n_a + n_b) <= (num + den) * (n_a + n_b - differ)


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def may_start(n_a, n_b, rest_a, rest_b, num: int, den: int):
    """Whether a token can be the first that two linked sets share, with so many of their tokens from it on.

    Before the first shared token nothing is common, so the overlap is at most the smaller rest.
    """
    return num * (n_a + n_b) <= (num + den) * np.minimum(rest_a, rest_b)


def _as_maps(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8) for x in column.to_pylist()]


class Join:
    """One run over ``docs(id, text)``; links are sets with num/den of their union in common."""

    def __init__(self, docs: DataFrame, n: int, num: int, den: int, gather: int = GATHER):
        self.docs, self.n, self.num, self.den, self.spark, self.most = docs, n, num, den, docs.sparkSession, gather
        self.scratch = Scratch(self.spark, "jaccard")

    def describe(self, total_bytes: int) -> np.ndarray:
        """Write each document's size, digest and bitmap; return the sketch of token counts (four steps to a doubling)."""
        n, counters = self.n, power_of_two(total_bytes >> 11, SKETCH, SKETCH_MOST)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, total = ["kind", "id", "n", "d1", "d2", "map"], np.zeros(counters, np.int64)
            for batch in batches:
                for part in chunks(batch):
                    sets = list(token_sets(part.column("text"), n))
                    total += np.bincount(np.concatenate(sets) & np.uint64(counters - 1), minlength=counters)
                    d1, d2 = zip(*map(digest, sets))
                    yield pa.RecordBatch.from_arrays([pa.array([0] * len(sets), pa.int32()), part.column("id"), pa.array(list(map(len, sets)), pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(list(map(bitmap, sets)), pa.binary())], names)
            if total.any():
                parts = [pack(x.astype(np.uint32)) for x in total.reshape(-1, SKETCH_PART)]
                some, none = pa.array(range(len(parts)), pa.int64()), pa.nulls(len(parts), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([1] * len(parts), pa.int32()), some, none, none, none, pa.array(parts, pa.binary())], names)

        both = self.scratch.put(self.docs.mapInArrow(run, "kind int, id long, n long, d1 long, d2 long, map binary"), "described", "kind")
        self.described = both.where("kind = 0").drop("kind")

        def add(key, parts):
            total = sum(unpack(x, np.uint32).astype(np.int64) for x in parts.column("map").to_pylist())
            return pa.table({"id": [key[0].as_py()], "map": pa.array([pack(total)], pa.binary())})

        sketch = np.zeros((counters // SKETCH_PART, SKETCH_PART), np.int64)
        for k, blob in both.where("kind = 1").select("id", "map").groupBy("id").applyInArrow(add, "id long, map binary").collect():
            sketch[k] = unpack(bytes(blob), np.int64)
        return (4 * np.log2(sketch.ravel() + 1)).astype(np.uint8)

    def meet(self, level: np.ndarray, total_bytes: int) -> None:
        """Write leader pairs and the groups of documents that share a prefix token.

        A token with more than ``most`` sets, by the sketch, is dealt to as many buckets as it takes; each
        has a leader of its own, which the rounds over whole tiles join.
        """
        n, num, den = self.n, self.num, self.den
        shared = self.spark.sparkContext.broadcast(level)
        hot = math.ceil(4 * math.log2(self.most + 1))
        buckets = power_of_two(total_bytes / (16 << 20), 64, 1 << 20)
        shift = np.uint64(65 - buckets.bit_length())

        def flush(got: list) -> Iterator[pa.RecordBatch]:
            tok, d, size, rest = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((d, tok))
            order = order[runs_of(tok[order], d[order])]
            tok, d, size, rest = tok[order], d[order], size[order], rest[order]
            known = shared.value[tok & np.uint64(len(shared.value) - 1)].astype(np.int64)
            parts = np.exp2(np.maximum(0, known - hot + 4) // 4).astype(np.uint64)
            bucket = np.where(parts > 1, mix(tok + mix(d.view(np.uint64)) % parts), tok) >> shift
            order = np.argsort(bucket, kind="stable")
            tok, d, size, rest, bucket = tok[order], d[order], size[order], rest[order], bucket[order]
            cut = runs_of(bucket)
            rows = [(int(bucket[i]), *(pack(x[i:j]) for x in (tok, d, size, rest))) for i, j in zip(cut, [*cut[1:], len(tok)])]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], ["bucket", "tok", "d", "n", "rest"])

        def hand_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got, count = [], 0
            for batch in batches:
                for part in chunks(batch):
                    for tokens in token_sets(part.column("text"), n):
                        if len(tokens):
                            order = np.argsort(shared.value[tokens & np.uint64(len(shared.value) - 1)], kind="stable")[: prefix_size(len(tokens), num, den)]
                            got.append((tokens[order], np.full(len(order), digest(tokens)[0]), np.full(len(order), len(tokens), np.uint32), np.arange(len(tokens), len(tokens) - len(order), -1, dtype=np.uint32)))
                            count += len(order)
                    if count > FLUSH:
                        yield from flush(got)
                        got, count = [], 0
            if count:
                yield from flush(got)

        def gather(key, rows):
            tok, d = unpack_all(rows.column("tok"), np.uint64), unpack_all(rows.column("d"), np.int64)
            size, rest = (unpack_all(rows.column(c), np.uint32).astype(np.int64) for c in ("n", "rest"))
            order = np.lexsort((d, size, tok))
            order = order[runs_of(tok[order], size[order], d[order])]
            cut = runs_of(tok[order])
            dealt = shared.value[tok[order][cut] & np.uint64(len(shared.value) - 1)] >= hot
            order = order[np.repeat((np.diff([*cut, len(order)]) > 1) | dealt, np.diff([*cut, len(order)]))]
            tok, d, size, rest = tok[order], d[order], size[order], rest[order]
            pairs, left = [np.zeros((0, 2), np.int64)], np.arange(len(tok))
            while len(left):  # each round's leaders take what fits their size; the rest has leaders of its own
                begin = runs_of(tok[left])
                lead = np.repeat(left[begin], np.diff([*begin, len(left)]))
                fits = size[lead] * den >= num * size[left]
                mine = fits & (lead != left) & may_start(size[lead], size[left], rest[lead], rest[left], num, den)
                pairs.append(np.stack([d[lead[mine]], d[left[mine]]], 1))
                left = left[~fits]
            pairs = np.unique(np.sort(np.concatenate(pairs), 1), axis=0)
            kind = np.repeat(np.array([0, 1], np.int32), [len(pairs), len(tok)])
            return pa.table({"kind": kind, "a": np.concatenate([pairs[:, 0], tok.view(np.int64)]), "b": np.concatenate([pairs[:, 1], d]), "n": np.concatenate([np.zeros(len(pairs), np.int64), size]), "rest": np.concatenate([np.zeros(len(pairs), np.int64), rest])})

        met = self.docs.mapInArrow(hand_out, "bucket int, tok binary, d binary, n binary, rest binary").groupBy("bucket").applyInArrow(gather, "kind int, a long, b long, n long, rest long")
        met = self.scratch.put(met, "met", "kind")
        self.pairs, self.groups = met.where("kind = 0").select("a", "b").distinct(), met.where("kind = 1").select(F.col("a").alias("tok"), F.col("b").alias("d1"), "n", "rest")

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) of digests that pass the bitmap bound."""
        num, den = self.num, self.den
        one = self.classes.select(F.col("d1").alias("a"), F.col("n").alias("n_a"), F.col("map").alias("map_a"))
        two = one.toDF("b", "n_b", "map_b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = _as_maps(batch.column("map_a")), _as_maps(batch.column("map_b"))
                n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
                shape = np.array([len(x) << 32 | len(y) for x, y in zip(a, b)], np.int64)
                keep = []
                for s in np.unique(shape):
                    i = np.flatnonzero(shape == s)
                    ok = may_link(n_a[i], n_b[i], np.stack([a[k] for k in i]), np.stack([b[k] for k in i]), num, den)
                    keep += i[ok].tolist()
                if keep:
                    yield batch.select(["a", "b"]).take(pa.array(keep))

        return pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "map_a", "map_b").mapInArrow(run, "a long, b long")

    def exact(self, pairs: DataFrame, name: str) -> DataFrame:
        """(a, b): representatives of those pairs of digests whose sets are linked, by exact intersection."""
        n, num, den, pairs = self.n, self.num, self.den, self.scratch.put(pairs.distinct(), f"{name}-bounded")
        count = pairs.count()
        ids = pairs.select(F.explode(F.array("a", "b")).alias("d1")).distinct().join(self.classes.select("rep", "d1", "d2"), "d1")
        ids = self.scratch.put(in_files(ids, 2 * count), f"{name}-ids")
        docs = self.docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids, F.expr("id = rep")).select("rep", "text", "d1", "d2")

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch):
                    sets = list(token_sets(part.column("text"), n))
                    same = [i for i, s in enumerate(sets) if digest(s) == (part.column("d1")[i].as_py(), part.column("d2")[i].as_py())]
                    some = part.select(["d1", "rep"]).take(pa.array(same, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array([sets[i].view(np.int64) for i in same], pa.list_(pa.int64()))], ["d1", "rep", "tokens"])

        def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cuts, flat = zip(*((np.asarray(c.offsets), np.asarray(c.values).view(np.uint64)) for c in (batch.column("x"), batch.column("y"))))
                keep = []
                for i in range(batch.num_rows):
                    x, y = (v[c[i] : c[i + 1]] for c, v in zip(cuts, flat))
                    c = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))  # both sorted
                    if den * c >= num * (len(x) + len(y) - c):
                        keep.append(i)
                yield batch.select(["rep_a", "rep_b"]).take(pa.array(keep, pa.int64())).rename_columns(["a", "b"])

        sets = self.scratch.put(docs.mapInArrow(read, "d1 long, rep long, tokens array<long>").dropDuplicates(["d1"]), f"{name}-sets")
        both = pairs.join(sets.toDF("a", "rep_a", "x"), "a").join(sets.toDF("b", "rep_b", "y"), "b").select("rep_a", "rep_b", "x", "y")
        linked = self.scratch.put(in_files(both.mapInArrow(common, "a long, b long"), count), f"{name}-links")
        self.scratch.drop(f"{name}-sets", f"{name}-ids", f"{name}-bounded")
        tidy(self.spark)
        return linked

    def placed(self) -> DataFrame:
        """(tok, tile, d1, n, rest, own): a tile holds a token's sets of one size band (``own``) and of the next."""
        band = F.floor(F.log(F.col("n").cast("double")) / math.log(self.den / self.num) + 1e-9).cast("int")
        places = F.array(F.struct(band.alias("tile"), F.lit(True).alias("own")), F.struct((band - 1).alias("tile"), F.lit(False).alias("own")))
        return self.groups.select("tok", "d1", "n", "rest", F.explode(places).alias("t")).select("tok", "t.tile", "d1", "n", "rest", "t.own")

    def open_rows(self, rows: DataFrame, joined: DataFrame, links: DataFrame, led: DataFrame | None) -> DataFrame:
        """``rows`` with their ``component`` and ``links``, of the tiles whose sets are not all joined.

        Links count for the choice of leaders: who is linked with most of those drawn before lies in
        the middle of a group.  Sets that were leaders (``led``) come last.  Sets whose rest is too small even for the smallest of their tile go: the token starts no link of theirs.
        """
        count = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
        label = self.classes.select("d1", "rep").join(joined.toDF("rep", "component"), "rep", "left").join(count, "rep", "left")
        label = label.select("d1", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
        if led is not None:
            label = label.join(led.withColumn("led", F.lit(-1)), "d1", "left").select("d1", "component", F.coalesce("led", "links").cast("long").alias("links"))
        rows = rows.select("tok", "tile", "d1", "n", "rest", "own").join(label, "d1")
        some = rows.groupBy("tok", "tile").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("own").alias("some"), F.min("n").alias("least")).where("low < high AND some")
        return rows.join(some.select("tok", "tile", "least"), ["tok", "tile"]).where(f"{self.num} * (n + least) <= {self.num + self.den} * rest").drop("least")

    def leads(self, rows: DataFrame, turn: int) -> DataFrame:
        """(tok, tile, leads): some leaders of each tile: the sets with most links, then by hash."""
        first = lambda k: F.min(F.struct(F.shiftright(-F.col("links"), k).alias("l"), F.xxhash64(F.lit(turn * LEADERS + k), "d1").alias("h"), "d1", "n", "rest", "component"))
        return rows.where("own").groupBy("tok", "tile").agg(F.array_distinct(F.array(*(first(k).dropFields("l", "h") for k in range(LEADERS)))).alias("leads"))

    def led(self, rows: DataFrame, leads: DataFrame) -> DataFrame:
        """(a, b): in each tile its leaders with all that are not joined to them and fit in size."""
        fits = f"component <> lead.component AND {self.den} * least(n, lead.n) >= {self.num} * greatest(n, lead.n) AND {self.num} * (n + lead.n) <= {self.num + self.den} * least(rest, lead.rest)"
        pairs = rows.join(leads, ["tok", "tile"]).select("d1", "n", "rest", "component", F.explode("leads").alias("lead")).where(fits)
        return pairs.select(F.least("d1", "lead.d1").alias("a"), F.greatest("d1", "lead.d1").alias("b")).distinct()

    def tiles(self, rows: DataFrame) -> DataFrame:
        """(a, b): pairs of digests of ``open_rows`` that pass the bound and are not joined."""
        num, den, label = self.num, self.den, self.classes
        size = rows.groupBy("tok", "tile").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
        rows = rows.join(size, ["tok", "tile"]).withColumn("part", F.pmod(F.xxhash64("d1"), F.col("parts")).cast("int"))
        rows = rows.select("tok", "tile", "d1", "n", "rest", "component", "own", "part", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("part", q).alias("p"), F.greatest("part", q).alias("q")))).alias("c"))
        rows = rows.join(label.select("d1", "map"), "d1").select(F.xxhash64("tok", "tile", "c").alias("key"), "n", "rest", "component", "own", "part", F.col("c.p").alias("p"), F.col("c.q").alias("q"), "d1", "map")
        many = int(self.spark.conf.get("spark.sql.shuffle.partitions")) * 4

        def run(key, rows):
            rows = rows.sort_by("key")
            tile, cut = np.asarray(rows.column("key")), None
            cut = runs_of(tile)
            n, rest, comp, own, part, p, q, rep = (np.asarray(rows.column(c)) for c in ("n", "rest", "component", "own", "part", "p", "q", "d1"))
            maps, out = _as_maps(rows.column("map")), [np.zeros((0, 2), np.int64)]
            for i, j in zip(cut, [*cut[1:], len(tile)]):
                size = min(len(maps[k]) for k in range(i, j))
                m = np.stack([fold(maps[k][None], size)[0] for k in range(i, j)])
                for k in range(i, j):
                    if not own[k]:
                        continue
                    # pairs of one band once; in a cut tile the two sides come from different parts
                    other = np.arange(i, j)
                    ok = (comp[i:j] != comp[k]) & ((rep[i:j] > rep[k]) | ~own[i:j]) & (np.minimum(n[i:j], n[k]) * den >= num * np.maximum(n[i:j], n[k]))
                    ok &= may_start(n[i:j], n[k], rest[i:j], rest[k], num, den)
                    ok &= (part[i:j] != part[k]) if p[k] != q[k] else True
                    other = other[ok]
                    if len(other):
                        other = other[may_link(n[other], n[k], m[other - i], m[k - i][None], num, den)]
                        out.append(np.stack([np.full(len(other), rep[k]), rep[other]], 1))
            pairs = np.unique(np.sort(np.concatenate(out), 1), axis=0)
            return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

        return rows.groupBy(F.pmod("key", F.lit(many))).applyInArrow(run, "a long, b long")

    def run(self) -> DataFrame:
        total = self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        level = self.describe(total)
        classes = self.described.where("n > 0 AND id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.first("map").alias("map"))
        self.classes = self.scratch.put(classes, "classes")
        self.meet(level, total)
        tidy(self.spark)
        # An id with several texts ties their classes together.
        own = self.described.where("n > 0 AND id IS NOT NULL").select("id", "d1", "d2")
        several = own.groupBy("id").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).where("low < high").select("id")
        ties = own.join(several, "id").join(self.classes.select("d1", "d2", "rep"), ["d1", "d2"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
        links = self.exact(self.bounded(self.pairs), "leaders").unionAll(self.scratch.put(ties, "ties"))
        joined = self.scratch.put(components(self.scratch, links, "cc"), "joined-0")
        rows, were = self.placed(), None
        for turn in range(1, ROUNDS + 1):
            rows = self.scratch.put(self.open_rows(rows, joined, links, were), f"open-{turn}")
            if turn > 1:
                self.scratch.drop(f"open-{turn - 1}")
            last = turn == ROUNDS or rows.isEmpty()
            if last:
                more = self.tiles(rows)
            else:
                leads = self.scratch.put(self.leads(rows, turn), f"leads-{turn}")
                new = leads.select(F.explode("leads.d1").alias("d1")).distinct()
                were = new if were is None else were.unionAll(new).distinct()
                more = self.bounded(self.led(rows, leads))
            more = self.exact(more, f"round-{turn}")
            links = links.unionAll(more)
            if not more.isEmpty():
                joined = self.scratch.put(components(self.scratch, links, "cc"), f"joined-{turn}")
            if last:
                break
        self.scratch.drop(f"open-{turn}")
        member = self.classes.join(joined.toDF("rep", "component"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
        member = self.scratch.put(member, "member")
        self.scratch.drop("met")
        out = self.described.select("id", "n", F.when(F.col("n") > 0, F.col("d1")).alias("d1"), "d2").join(member, ["d1", "d2"], "left")
        return out.select("id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("id").isNotNull(), F.col("component")), "id").alias("component_id"))


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", gather: int = GATHER) -> DataFrame:
    """(id_col, n_shingles, component_id): groups of documents linked by Jaccard >= num/den.

    A document's set holds its distinct runs of ``words`` words, lower-cased in A-Z; with fewer words
    the whole sequence is the only member.  component_id is the smallest id reachable by links, the
    document's own included.

    Null and empty texts have empty sets, which link with nothing, not even each other.  Rows without an
    id have no component and link nothing.  Rows that repeat an id are one node: what is linked with
    either text is linked with both.  Other columns are ignored; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with small_batches(docs.sparkSession):  # all that Python does is written inside
        out = Join(rows, words, num, den, gather).run()
    return out.withColumnRenamed("id", id_col)
