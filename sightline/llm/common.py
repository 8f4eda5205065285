"""Shared pieces: scratch tables, word and n-gram hashing over Arrow buffers, connected components.

Hashes here are plain functions of the bytes (no process salt), so every executor and every retry
of a lost task gets the same values.
"""

from __future__ import annotations

import contextlib
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.sources.scratch import Scratch

#: Words are runs of anything but space and the ASCII controls 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For other tokens: all bytes but ASCII letters, digits and UTF-8's; all bytes but punctuation.
NO_LETTER = ~np.array([chr(b).isalnum() or b > 127 for b in range(256)])
NO_MARK = ~NO_LETTER | SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text bytes hashed in one go; bounds a worker's memory (about 150 bytes for each).
CHUNK_BYTES = 1 << 19
#: Ids that may be broadcast: at most this many 8-byte keys; beyond it joins shuffle.
BROADCAST_KEYS = 200_000
#: Narrow rows (a few numbers each) in a file of a small intermediate table, at most.
FILE_ROWS = 1 << 18


def tidy(spark: SparkSession) -> None:
    """Let the driver's cleaner remove shuffle files of finished jobs now rather than some time."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 512):
    """Fewer rows in the Arrow batches of what is run inside; the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows if int(before) <= 0 else min(rows, int(before)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def in_files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, known to hold at most ``rows`` narrow rows, in as many files as that takes.

    What a shuffle dealt to many tasks is a crowd of tiny files else, each made, renamed and opened by
    itself.  From as many files as the shuffle has tasks on nothing is changed.
    """
    files = max(1, -(-rows // FILE_ROWS))
    return df if files >= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(files)


def power_of_two(x: float, least: int, most: int) -> int:
    n = least
    while n < x and n < most:
        n *= 2
    return n


# ---------------------------------------------------------------- hashing

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_S = [np.uint64(x) for x in (30, 27, 31)]
#: Bases, for bytes and for words, of polynomial hashes modulo a prime and, independent of these, modulo 2**64.
PRIME = (1 << 61) - 1
_BASES = ((0x0342543DE82EF95B, 0x00761D6478BD642F), (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
_P, _LOW31, _LOW30, _LOW32 = (np.uint64(x) for x in (PRIME, (1 << 31) - 1, (1 << 30) - 1, (1 << 32) - 1))
_U = {k: np.uint64(k) for k in (1, 30, 31, 32, 61)}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: 64 well-mixed bits."""
    x = x + _K[0]
    x = (x ^ (x >> _S[0])) * _K[1]
    x = (x ^ (x >> _S[1])) * _K[2]
    return x ^ (x >> _S[2])


def _fold(x: np.ndarray) -> np.ndarray:
    """Any 64 bits modulo the prime."""
    x = (x & _P) + (x >> _U[61])
    return np.where(x >= _P, x - _P, x)


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, of numbers below it, by halves of 31 bits."""
    a1, a0, b1, b0 = a >> _U[31], a & _LOW31, b >> _U[31], b & _LOW31
    middle = a1 * b0 + a0 * b1
    high = (a1 * b1 << _U[1]) + (middle >> _U[30])
    return _fold(_fold(high + ((middle & _LOW30) << _U[31])) + _fold(a0 * b0))


class _Modular:
    """Hashes of runs from running sums, modulo 2**61 - 1."""

    @staticmethod
    @functools.lru_cache(32)
    def _table(base: int, n: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < n:  # powers below k, then those below 2 k
            out = np.concatenate([out, mulmod(out, np.full(1, pow(base, len(out), PRIME), np.uint64))])
        return out

    def powers(self, base: int, n: int, inverse: bool = False) -> np.ndarray:
        return self._table(pow(base, -1, PRIME) if inverse else base, power_of_two(n + 1, 1 << 16, 1 << 40))[:n]

    def sums(self, values: np.ndarray, base: int) -> np.ndarray:
        terms = mulmod(_fold(values), self.powers(base, len(values)))
        low, high = np.cumsum(terms & _LOW32), np.cumsum(terms >> _U[32])
        total = np.zeros(len(values) + 1, np.uint64)
        total[1:] = _fold(mulmod(_fold(high), np.full(1, 1 << 32, np.uint64)) + _fold(low))
        return total

    def run(self, total: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
        return mulmod(_fold(total[end] + _P - total[start]), self.powers(base, len(total), True)[start])


class _Wrapping:
    """The same modulo 2**64: cheaper, but with known collisions; used as the second of two."""

    @staticmethod
    @functools.lru_cache(32)
    def _table(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def powers(self, base: int, n: int, inverse: bool = False) -> np.ndarray:
        return self._table(pow(base, -1, 1 << 64) if inverse else base, power_of_two(n + 1, 1 << 16, 1 << 40))[:n]

    def sums(self, values: np.ndarray, base: int) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers(base, len(values)), out=total[1:])
        return total

    def run(self, total: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
        return (total[end] - total[start]) * self.powers(base, len(total), True)[start]


_FAMILY = (_Modular(), _Wrapping())
#: Bytes of a word up to which sums that wrap are good hashes: a wrapping sum over the two-letter words
#: of a Thue-Morse pair is the same from some 1,000 letters on, and differs in half its bits at 64.
SURE = 64


@functools.lru_cache(8)
def _tables(family: int) -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * (family + 1))) >> np.uint64(3 * (family == 0))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets from 0) of a string array; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offs = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def chunks(batch, column: str = "text", limit: int = CHUNK_BYTES):
    """Slices of a batch with at most ``limit`` bytes of text, or one row."""
    _, offs = bytes_of(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = j


class Words:
    """The words of a slice of texts: start, end, row and hash(es) of each."""

    def __init__(self, texts: pa.Array, lower: bool = False, families: int = 1, space: np.ndarray = SPACE):
        data, self.offs = bytes_of(texts)
        data = LOWER[data] if lower else data
        n, word = len(data), ~space[data]
        first = np.zeros(n + 1, bool)
        first[self.offs] = True
        start, end = word.copy(), word.copy()
        start[1:] &= ~word[:-1] | first[1:n]
        end[:-1] &= ~word[1:] | first[1:n]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.row = np.searchsorted(self.offs, self.start, side="right") - 1
        self.hash, self.rows, self.data = [], len(texts), data
        size = self.end - self.start
        for f in range(families):
            table, base = _tables(f), _BASES[f][0] | 1
            h = _FAMILY[1].run(_FAMILY[1].sums(table[data], base), self.start, self.end, base)
            long = np.flatnonzero(size > SURE) if f == 0 else size[:0]
            if len(long):  # sums that wrap confuse some long words
                ends = np.cumsum(size[long])
                at = np.arange(ends[-1]) + np.repeat(self.start[long] - ends + size[long], size[long])
                h[long] = _FAMILY[0].run(_FAMILY[0].sums(table[data[at]], _BASES[0][0]), ends - size[long], ends, _BASES[0][0])
            self.hash.append(mix(h + size.astype(np.uint64) * _K[1]))

    def ngrams(self, n: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of ``n`` words inside one text."""
        m = len(self.start)
        if m < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        own, base = _FAMILY[family], _BASES[family][1]
        total = own.sums(self.hash[family], base)
        at = np.flatnonzero(self.row[: m - n + 1] == self.row[n - 1 :])
        return at, mix(own.run(total, at, at + n, base))

    def whole(self, row: int) -> np.ndarray:
        """The hash of all words of one text, as one number, told apart by how many there are."""
        i, j = np.searchsorted(self.row, [row, row + 1])
        own, base = _FAMILY[0], _BASES[0][1]
        total = own.sums(self.hash[0][i:j], base)
        return mix(mix(own.run(total, np.zeros(1, np.int64), np.full(1, j - i), base)) + np.full(1, j - i, np.uint64) * _K[2])

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of ``n`` words, hashed as :meth:`whole` does."""
        m = len(self.start)
        if m < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        own, base = _FAMILY[0], _BASES[0][1]
        total = own.sums(self.hash[0], base)
        at = np.flatnonzero(self.row[: m - n + 1] == self.row[n - 1 :])
        return at, mix(mix(own.run(total, at, at + n, base)) + np.full(1, n, np.uint64) * _K[2])

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def bounds(self, at: np.ndarray | None = None) -> np.ndarray:
        """Where each text's entries begin among ``at`` (default: among all words), and the end."""
        rows = self.row if at is None else self.row[at]
        return np.searchsorted(rows, np.arange(self.rows + 1))


def pack(a: np.ndarray) -> bytes:
    """Integers as zstd-compressed byte planes; sorted or narrow values get small."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpack(b: bytes, kind) -> np.ndarray:
    size, kind = int.from_bytes(b[:8], "little"), np.dtype(kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(b[8:], size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


def unpack_all(column, kind) -> np.ndarray:
    got = [unpack(x, kind) for x in column.to_pylist()]
    return np.concatenate(got) if got else np.zeros(0, kind)


def runs_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal (sorted) keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


# ---------------------------------------------------------------- graphs


def components(scratch: Scratch, links: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for nodes of ``links(a, b)``; component is the smallest node reachable.

    Alternates large-star and small-star steps, each one aggregation and one join by node; the
    edges are written after each round, so a lost executor costs one round.  A node's row of
    neighbours is never gathered: only its minimum is.
    """
    spark = scratch.spark
    edges = links.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct()
    edges, k, before = scratch.put(edges, f"{name}-0"), 0, None
    count = edges.count()
    while True:
        both = edges.unionAll(edges.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        k += 1
        new = scratch.put(in_files(small, 2 * count), f"{name}-{k}")  # an edge makes two at most
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{k - 1}")
        edges, count = new, state[0]
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
