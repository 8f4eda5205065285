"""WARC archives: written by tasks, read back in byte ranges.

Each record is a gzip member of its own.  A reading task looks for the gzip magic in its range,
takes a candidate for a record only if it inflates to a WARC header, and owns the records that
start inside its range, however far they reach.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import Scratch

MAGIC, VERSION, BREAK = b"\x1f\x8b\x08", b"WARC/1.1", b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
#: Ids of the records that are written here.
PAGE = "<urn:page:"
#: Bytes read at a time; tasks that share the rows of one payload.
PIECE, SALTS = 1 << 20, 16


def record(kind: str, page: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record as a gzip member; a revisit holds the HTTP head without the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (payload if kind == "response" else b"")
    uri = "".join((url or "").split())
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {PAGE}{'' if page is None else page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {PAGE}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    raw = VERSION + BREAK + "\r\n".join(head).encode() + BREAK * 2 + block + BREAK * 2
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _head(text: str) -> dict[str, str]:
    """Fields of a header, by lower-case name; a line that begins with space goes on with the last."""
    out, last = {}, None
    for line in text.split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _sha1(text: str | None) -> str | None:
    """A ``sha1:`` digest, in base 32 or hex, as hex; None for others."""
    name, _, value = (text or "").partition(":")
    if name.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def _page(uri: str | None) -> int | None:
    """The id of a record that :func:`record` wrote."""
    number = (uri or "")[len(PAGE) : -1]
    return int(number) if (uri or "").startswith(PAGE) and number.lstrip("-").isdigit() else None


def split_records(raw: bytes) -> Iterator[bytes]:
    """The records of a member, which by rule holds one."""
    at = 0
    while at < len(raw):
        end = raw.find(BREAK * 2, at)
        if end < 0:
            raise ValueError("a record without the end of its header")
        size = end + 4 + int(_head(raw[at:end].decode("utf-8", "replace"))["content-length"])
        if size > len(raw):
            raise ValueError("a record shorter than its header says")
        yield raw[at:size]
        at = size
        while raw[at : at + 2] == BREAK:
            at += 2


def parse(raw: bytes) -> tuple:
    """The values of ``FIELDS`` for a record.

    Its payload is what follows the HTTP header, or the whole block of a record without one.  The
    digest is computed from the payload, of a revisit taken from the header; one that contradicts a
    sha1 in the header is told in ``error``.
    """
    head, _, block = raw.partition(BREAK * 2)
    fields = _head(head.decode("utf-8", "replace"))
    block, kind, http = block[: int(fields["content-length"])], fields["warc-type"], {}
    payload = block
    if fields.get("content-type", "").startswith("application/http") or block.startswith(b"HTTP/"):
        top, _, payload = block.partition(BREAK * 2)
        http = _head(top.decode("latin-1"))
    said, error = _sha1(fields.get("warc-payload-digest")), None
    size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    if kind == "revisit":
        payload, digest = None, said
    else:
        digest = hashlib.sha1(payload).hexdigest()
        if kind == "response" and said is not None and digest != said:
            error = "the payload contradicts its digest"
        size = len(payload)
    return _page(fields.get("warc-record-id")), fields.get("warc-target-uri", ""), kind, size, digest, _page(fields.get("warc-refers-to")), fields.get("warc-record-id"), fields.get("warc-date"), error, payload


def _member(file, at: int, size: int) -> tuple[bytes | None, int] | None:
    """(content, end) of the gzip member at ``at``; None if it is no WARC record, content None if it is a damaged one."""
    inflate, got, place, ok = zlib.decompressobj(31), [], at, False
    while True:
        file.seek(place)
        piece = file.read(4096 if place == at else PIECE)
        try:
            got.append(inflate.decompress(piece))
        except zlib.error:
            return (None, at + 1) if ok else None
        place += len(piece)
        if not ok and sum(map(len, got)) >= len(VERSION):
            if not b"".join(got).startswith(b"WARC/1."):
                return None
            ok = True
        if inflate.eof:
            return (b"".join(got), place - len(inflate.unused_data)) if ok else None
        if place >= size or not piece:
            return (None, at + 1) if ok else None


def _starts(file, at: int) -> bool:
    """Whether a member begins at ``at`` whose content begins as a record."""
    file.seek(at)
    try:
        return zlib.decompressobj(31).decompress(file.read(4096)).startswith(b"WARC/1.")
    except zlib.error:
        return False


def scan(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes | None]]:
    """(offset, content) of the records that start in [start, end); content None where there is damage.

    A damaged record is told by the task that owns its start; bytes after a record that begin no other
    by the task that owns the record, and a file that begins with none by its first task.
    """
    at = start
    if start == 0 and not _starts(file, 0):
        yield 0, None
    while at < end:
        file.seek(at)
        piece = file.read(min(PIECE, end + len(MAGIC) - 1 - at))
        found = piece.find(MAGIC)
        if found < 0 or at + found >= end:
            if len(piece) < len(MAGIC) or at + len(piece) >= end:
                return
            at += len(piece) - len(MAGIC) + 1
            continue
        at += found
        got = _member(file, at, size)
        if got is None:
            at += 1
            continue
        yield at, got[0]
        if got[0] is not None and got[1] < size and not _starts(file, got[1]):
            yield got[1], None
        at = got[1]


def _file(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":/", ":///", 1))


def dedup_plan(rows: DataFrame, least: int) -> DataFrame:
    """``rows(id, url, html, digest)`` with ``refers_to`` where a row becomes a revisit.

    Of equal payloads only the largest id is sought, so groups are combined before they meet; a
    group's rows are dealt to ``SALTS`` tasks when that id is joined back.
    """
    long_ = F.octet_length(F.coalesce("html", F.lit(""))) >= least
    groups = rows.where(long_).groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL")
    groups = groups.select(F.col("digest").alias("key"), "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    salted = rows.withColumn("key", F.when(long_, F.col("digest"))).withColumn("part", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    return salted.join(groups, ["key", "part"], "left").select("id", "url", "html", "digest", F.when(F.col("id") != F.col("last"), F.col("last")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 1000) -> DataFrame:
    """Write one archive a task into ``folder``; (path, size) of the archives.

    Of equal payloads of ``least`` bytes or more the row with the largest id becomes a response and
    the others revisits of it; rows that repeat that id stay responses, and so do rows without an id.  Null payloads are empty,
    null ids and urls stay null or empty.  The list must be written by the caller before it is read
    twice: an archive of a task that is run again gets another name, and only those listed count.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(text_col).alias("html"), F.sha1(F.coalesce(text_col, F.lit("")).cast("binary")).alias("digest"))
    rows = dedup_plan(rows, least).select("id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, size, out, path = TaskContext.get(), 0, None, ""
        for batch in batches:
            for page, url, html, to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None:
                    path = f"{folder}/part-{context.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    fs, local = _file(path)
                    fs.create_dir(local.rpartition("/")[0])
                    out = fs.open_output_stream(local, compression=None)
                data = record("response" if to is None else "revisit", page, url, (html or "").encode(), to)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size])], ["path", "size"])

    return rows.mapInArrow(run, "path string, size long")


#: Columns of a record that is read, and of a place where there is damage (``error``).
FIELDS = (("page_id", "long", pa.int64()), ("url", "string", pa.string()), ("record_type", "string", pa.string()), ("payload_bytes", "long", pa.int64()), ("payload_digest", "string", pa.string()), ("refers_to", "long", pa.int64()), ("record_id", "string", pa.string()), ("date", "string", pa.string()), ("error", "string", pa.string()), ("payload", "binary", pa.binary()))


def read_warc(files: DataFrame, split_bytes: int = 16 << 20, payloads: bool = False) -> DataFrame:
    """Records of ``files(path, size)`` of any origin, read in ranges of ``split_bytes``.

    ``FIELDS`` and the record's place (path, offset); payload on request (null for revisits).  page_id
    and refers_to are those of archives that :func:`write_warc` wrote.  Damaged records, and bytes that
    belong to none, give a row with ``error``.  Empty files have no ranges and no records.
    """
    ranges = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(int(split_bytes)).cast("long"))).alias("start"))
    ranges = ranges.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    columns = FIELDS if payloads else FIELDS[:-1]

    def rows(path: str, at: int, raw: bytes | None) -> Iterator[tuple]:
        bad = lambda text: (*[None] * 8, text, None)
        try:
            if raw is None:
                yield *bad("damaged")[: len(columns)], path, at
            else:
                for one in split_records(raw):
                    yield *parse(one)[: len(columns)], path, at
        except (ValueError, KeyError) as lost:
            yield *bad(f"no record: {lost}")[: len(columns)], path, at

    def batch_of(got: list[tuple]) -> pa.RecordBatch:
        kinds = [k for _, _, k in columns] + [pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*got), kinds)], [n for n, _, _ in columns] + ["path", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                fs, local = _file(path)
                got, held = [], 0
                with fs.open_input_file(local) as file:
                    for at, raw in scan(file, size, start, min(size, start + split_bytes)):
                        got += rows(path, at, raw)
                        held += len(raw or b"") if payloads else 0
                        if len(got) >= 256 or held > PIECE * 8:
                            yield batch_of(got)
                            got, held = [], 0
                if got:
                    yield batch_of(got)

    schema = ", ".join([*(f"{n} {k}" for n, k, _ in columns), "path string", "offset long"])
    return ranges.mapInArrow(run, schema)


def archive(pages: DataFrame, split_bytes: int = 16 << 20, **columns) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read these back; see both for nulls and repeats."""
    scratch = Scratch(pages.sparkSession, "warc")
    files = scratch.put(write_warc(pages, f"{scratch.path}/archives", **columns), "files")
    return read_warc(files, split_bytes)
