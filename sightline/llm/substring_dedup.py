"""Removal of long repeated word sequences with a log-structured fingerprint index.

The index is a list of immutable runs.  A run holds the sorted, distinct 96-bit fingerprints of all
windows of some batches, cut into buckets by the leading bits.  A new batch is hashed, combined on
the map side (one entry for each fingerprint and chunk), shuffled to the buckets and merge-joined
with the runs there: the leading 64 bits, of a hash modulo a prime, find a candidate, the
other 32, from an independent hash of the same bytes modulo 2**64, verify it.  What is new becomes the next run; when there are more than
``max_runs``, the runs are merged into one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import Scratch, Words, chunks, mix, pack, power_of_two, runs_of, small_batches, tidy, unpack, unpack_all

#: Rows without an id come after all others.
NO_ID = (1 << 63) - 1
ROWS = "kind int, bucket int, shard int, a binary, b binary, c binary"
ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("shard", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
KEPT = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
#: A document's shard, as numpy and SQL both compute it without overflow.
PRIME, FACTOR = (1 << 31) - 1, 1_073_741_789
#: A session's limit of buckets, raised while an index is open.
MAX_BUCKETS = "spark.sql.sources.bucketing.maxBuckets"
#: Windows gathered before a flush; bounds a worker's memory.
FLUSH = 1_500_000


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 6, ARROW)], schema=ARROW)


def _marks(docs: np.ndarray, hashes: np.ndarray, shards: int, buckets: int) -> list[tuple]:
    """Rows that tell documents which of their windows go."""
    shard = docs % PRIME * FACTOR % PRIME % shards
    order = np.argsort(shard, kind="stable")
    shard, docs, hashes = shard[order], docs[order], hashes[order]
    at = runs_of(shard)
    return [(1, int(shard[i]) % buckets, int(shard[i]), pack(docs[i:j]), pack(hashes[i:j]), b"") for i, j in zip(at, [*at[1:], len(shard)])]


def _sorted(h: np.ndarray, c: np.ndarray, d: np.ndarray):
    """Entries by fingerprint, the beginnings of equal ones and the smallest id of each."""
    order = np.argsort(h, kind="stable")
    at = runs_of(h[order])
    if len(at) != len(runs_of(h[order], c[order])):  # equal in the leading 64 bits only
        order = np.lexsort((c, h))
        at = runs_of(h[order], c[order])
    h, c, d = h[order], c[order], d[order]
    return h, c, d, at, np.minimum.reduceat(d, at) if len(at) else d[:0]


def _hash_batch(n: int, buckets: int, shards: int):
    bits = np.uint64(64 - buckets.bit_length() + 1)

    def flush(got: list) -> Iterator[pa.RecordBatch]:
        h, c, d, at, least = _sorted(*(np.concatenate(x) for x in zip(*got)))
        rows = []
        own = np.repeat(least, np.diff([*at, len(h)])) < d
        rows += _marks(d[own], h[own], shards, buckets)  # passed on through some bucket
        h, c, bucket = h[at], c[at], h[at] >> bits
        cut = runs_of(bucket)
        rows += [(0, int(bucket[i]), None, pack(h[i:j]), pack(c[i:j]), pack(least[i:j])) for i, j in zip(cut, [*cut[1:], len(bucket)])]
        for i in range(0, len(rows), 256):
            yield _table(rows[i : i + 256])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0
        for batch in batches:
            for part in chunks(batch):
                w = Words(part.column("text"), families=2)
                at, h = w.ngrams(n, 0)
                _, c = w.ngrams(n, 1)
                got.append((h, (c >> np.uint64(32)).astype(np.uint32), part.column("doc").to_numpy()[w.row[at]]))
                size += len(h)
                if size > FLUSH:
                    yield from flush(got)
                    got, size = [], 0
        if size:
            yield from flush(got)

    return run


def _merge(shards: int):
    def run(key, new, old):
        rows, bucket = [], key[0].as_py()
        kinds = np.asarray(new.column("kind"))
        local = new.filter(pa.array(kinds == 1))
        rows += [(1, bucket, s, a, b, b"") for s, a, b in zip(*(local.column(x).to_pylist() for x in ("shard", "a", "b")))]
        new = new.filter(pa.array(kinds == 0))
        if new.num_rows:
            h, c, d, at, least = _sorted(*(unpack_all(new.column(x), k) for x, k in (("a", np.uint64), ("b", np.uint32), ("c", np.int64))))
            known = np.zeros(len(at), bool)
            for a, b in zip(old.column("a").to_pylist(), old.column("b").to_pylist()):
                was, check = unpack(a, np.uint64), unpack(b, np.uint32)
                i = np.searchsorted(was, h[at], side="left")
                open_ = np.flatnonzero(i < len(was))
                while len(open_):  # equal leading bits: walk along them until the check agrees
                    open_ = open_[was[i[open_]] == h[at][open_]]
                    known[open_[check[i[open_]] == c[at][open_]]] = True
                    open_ = open_[~known[open_]]
                    i[open_] += 1
                    open_ = open_[i[open_] < len(was)]
            gone = np.repeat(known, np.diff([*at, len(h)])) | (np.repeat(least, np.diff([*at, len(h)])) < d)
            rows += [(k, bucket, *rest) for k, _, *rest in _marks(d[gone], h[gone], shards, 1)]
            fresh = at[~known]
            if len(fresh):
                rows.append((0, bucket, None, pack(h[fresh]), pack(c[fresh]), b""))
        return pa.Table.from_batches([_table(rows)])

    return run


def _compact(key, runs):
    h, c = unpack_all(runs.column("a"), np.uint64), unpack_all(runs.column("b"), np.uint32)
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    at = runs_of(h, c)
    return pa.Table.from_batches([_table([(0, key[0].as_py(), None, pack(h[at]), pack(c[at]), b"")])])


class FingerprintIndex:
    """Fingerprints of all windows seen so far; lives in a folder that the cluster shares.

    ``buckets`` fixes how the runs are cut and ``shards`` how documents are dealt out; both are set
    once, from the size that the corpus is expected to reach.  With a ``path`` the index stays when the
    process ends: its manifest is written after each run, and :meth:`open` goes on from there.
    """

    def __init__(self, spark: SparkSession, words: int = 13, total_bytes: int = 0, max_runs: int = 2, path: str | None = None, bucket_bytes: int = 8 << 20):
        # From 64 buckets on their number grows with the corpus; beyond half a terabyte buckets grow too.
        self.buckets = power_of_two(total_bytes / bucket_bytes, 64, 1 << 16)
        self.buckets = power_of_two(total_bytes / (8 * bucket_bytes), self.buckets, 1 << 20)
        self.shards = power_of_two(total_bytes / (4 << 20), 64, 1 << 25)
        self._start(spark, words, max_runs, path, [], 0)

    def _start(self, spark: SparkSession, words: int, max_runs: int, path: str | None, runs: list[int], batches: int) -> None:
        self.spark, self.words, self.max_runs, self.runs, self.batches = spark, words, max_runs, runs, batches
        self.scratch, self.durable = Scratch(spark, "fingerprints"), path is not None
        self.table = self.scratch.path.rpartition("/")[2].replace("-", "_")
        self.scratch.path = path.rstrip("/") if path else self.scratch.path
        self.limit = spark.conf.get(MAX_BUCKETS)
        spark.conf.set(MAX_BUCKETS, max(int(self.limit), self.buckets))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index that an earlier process left in ``path``."""
        about = json.loads(spark.read.text(f"{path.rstrip('/')}/manifest.json", wholetext=True).first()[0])
        index = cls.__new__(cls)
        index.buckets, index.shards = about["buckets"], about["shards"]
        index._start(spark, about["words"], about["max_runs"], path, about["runs"], about["batches"])
        spark.sql(f"CREATE TABLE {index.table} ({ROWS}, batch int) USING parquet OPTIONS (path '{index.scratch.path}/log') PARTITIONED BY (batch, kind) CLUSTERED BY (bucket) INTO {index.buckets} BUCKETS")
        spark.sql(f"ALTER TABLE {index.table} RECOVER PARTITIONS")
        return index

    def _save(self) -> None:
        """Write the manifest; runs that it does not name do not count."""
        if self.durable:
            names = ("words", "max_runs", "buckets", "shards", "runs", "batches")
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.scratch.path}/manifest.json")
            out = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(p, True)
            out.write(bytearray(json.dumps({k: getattr(self, k) for k in names}).encode()))
            out.close()

    def _log(self, rows: DataFrame) -> int:
        """Append rows to the index: a table in as many buckets as the runs are cut into.

        A run's bucket is read where it lies: only new fingerprints are shuffled to meet it.
        """
        name, self.batches = self.batches, self.batches + 1
        writer = rows.withColumn("batch", F.lit(name)).write.mode("append").option("compression", "zstd").option("path", f"{self.scratch.path}/log")
        writer.partitionBy("batch", "kind").bucketBy(self.buckets, "bucket").saveAsTable(self.table)
        self.runs.append(name)
        self._save()
        tidy(self.spark)
        return name

    def _runs(self) -> DataFrame:
        if not self.runs:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.table(self.table).where(F.col("batch").isin(self.runs) & (F.col("kind") == 0))

    def add(self, batch: DataFrame) -> int:
        """Merge ``batch(doc, text)`` with the runs; the number under which its marks are kept."""
        new = batch.mapInArrow(_hash_batch(self.words, self.buckets, self.shards), ROWS)
        with small_batches(self.spark):
            return self._log(new.groupBy("bucket").cogroup(self._runs().groupBy("bucket")).applyInArrow(_merge(self.shards), ROWS))

    def compact(self) -> None:
        """Merge all runs into one; fingerprints in several runs are kept once."""
        was, merged = self.runs, self._runs().groupBy("bucket").applyInArrow(_compact, ROWS)
        self.runs = []
        self._log(merged)
        self.forget(was)  # after the manifest names the merged run

    def forget(self, runs: list[int]) -> None:
        """Delete runs; the marks of their batches stay."""
        self.scratch.drop(*(f"log/batch={x}/kind=0" for x in runs))
        self.spark.catalog.refreshTable(self.table)

    def close(self) -> None:
        """Take the table out of the catalog; an index without a path of its own loses its runs."""
        if not self.durable:
            self.scratch.drop(*(f"log/batch={x}/kind=0" for x in self.runs))
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self.spark.conf.set(MAX_BUCKETS, self.limit)

    def marks(self, names: list[int]) -> DataFrame:
        rows = self.scratch.get("log", "bucket int, shard int, a binary, b binary, c binary, batch int, kind int")
        return rows.where(F.col("batch").isin(names) & (F.col("kind") == 1)).select("shard", "a", "b")

    def clean(self, docs: DataFrame, names: list[int]) -> DataFrame:
        """(doc, n_words, n_removed, kept) of ``docs(doc, text)``, by the marks in ``names``."""
        shards, n = self.shards, self.words
        marks = self.marks(names)
        schema = "doc long, n_words long, n_removed long, kept string"
        docs = docs.select("doc", "text", F.expr(f"pmod(pmod(doc, {PRIME}) * {FACTOR}, {PRIME}) % {shards}").cast("int").alias("shard"))
        return docs.groupBy("shard").cogroup(marks.groupBy("shard")).applyInArrow(_clean(n), schema)


def _clean(n: int):
    def run(key, docs, marks):
        ids, seqs = unpack_all(marks.column("a"), np.int64), unpack_all(marks.column("b"), np.uint64)
        gone = np.unique(mix(mix(ids.view(np.uint64)) ^ seqs))
        done = [_kept(part, n, gone) for batch in docs.to_batches() for part in chunks(batch)]
        return pa.Table.from_batches(done, KEPT)

    return run


def _kept(part: pa.RecordBatch, n: int, gone: np.ndarray) -> pa.RecordBatch:
    w, doc = Words(part.column("text")), part.column("doc").to_numpy()
    at, h = w.ngrams(n)
    keys = mix(mix(doc.view(np.uint64))[w.row[at]] ^ h)
    hit = at[gone[np.minimum(np.searchsorted(gone, keys), len(gone) - 1)] == keys] if len(gone) else at[:0]
    depth = np.zeros(len(w.start) + 1, np.int64)
    depth[hit] += 1
    np.subtract.at(depth, hit + n, 1)
    stay = np.cumsum(depth[:-1]) == 0
    bounds, removed, kept = w.bounds(), [], []
    for k, text in enumerate(part.column("text").to_pylist()):
        i, j = bounds[k], bounds[k + 1]
        mask, words = stay[i:j], (text or "").encode().split()
        removed.append(j - i - int(mask.sum()))
        kept.append(b" ".join(compress(words, mask.tolist()) if removed[-1] else words).decode())
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema=KEPT)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 13, batches: int = 4) -> DataFrame:
    """Remove every word inside a window of ``words`` words that an earlier document also has.

    Earlier means a smaller id.  Documents are added in ``batches`` ranges of ids, so that history
    always holds smaller ids.  Windows are judged on the input.  Returns (id_col, n_words,
    n_removed, kept): ``kept`` are the words that stay, joined by one space.

    Null or empty text: no words, ``kept`` is empty.  Rows with one id are one document that was
    written several times: they never remove words from each other.  Rows without an id come after
    all others and come back without an id.  Other columns are ignored, an empty table gives none.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).cast("string").alias("text"))
    low, high, size = docs.agg(F.min("doc"), F.max(F.when(F.col("doc") < NO_ID, F.col("doc"))), F.sum(F.octet_length("text"))).first()
    index = FingerprintIndex(spark, words, size or 0)
    low, high = low or 0, high if high is not None else low or 0
    step = max(1, -(-(high - low + 1) // batches))
    names = []
    try:
        for k in range(batches):
            last = k == batches - 1
            batch = docs.where((F.col("doc") >= low + k * step) & (F.lit(True) if last else F.col("doc") < low + (k + 1) * step))
            if len(index.runs) > index.max_runs:
                index.compact()
            names.append(index.add(batch))
    finally:
        index.close()
    out = index.clean(docs, names)
    return out.select(F.when(F.col("doc") < NO_ID, F.col("doc")).alias(id_col), "n_words", "n_removed", "kept")
