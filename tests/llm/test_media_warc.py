import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from helpers import HAS_SF, SF
from sightline.llm import media_ts as M
from sightline.llm import queries as Q
from sightline.llm import warc as W


def test_round_trip():
    for n in [0, 1, 170, 175, 176, 177, 183, 184, 185, 3840, 3841, 3840 * 8, 3840 * 9 + 17, *range(340, 380), 200_000]:
        data = bytes((i * 7 + n) & 255 for i in range(n))
        media = M.mux(data)
        got = M.demux(media)
        assert got.payload == data and not got.gaps and len(media) % 188 == 0
        assert got.pts == [k * M.TICKS for k in range(len(got.pts))]
        assert got.random_access == [k % M.GROUP == 0 for k in range(len(got.pts))] and got.offset == [k * M.UNIT for k in range(len(got.pts))]


def test_damage():
    data = bytes(i * i >> 3 & 255 for i in range(10_000))
    media = M.mux(data)
    for k in (1, 15, 16, 17):  # as many lost packets as the counter takes to come round again
        got = M.demux(media[: 188 * 5] + media[188 * (5 + k) :])
        assert (got.gaps, len(got.damaged) >= 1) == (k != 16, True) and len(got.payload) < 10_000
    assert M.demux(media[: 188 * 6] + media[188 * 5 :]).payload == data  # a packet sent twice
    with pytest.raises(ValueError):
        M.demux(media[:7] + b"\x99" + media[8:])
    with pytest.raises(ValueError):
        M.demux(media[1:] + b"x")
    assert M.demux(media[:-188]).damaged  # cut off: the last unit is shorter than its head says
    assert M.crc32_mpeg(b"123456789") == 0x0376E6E7


def packet(pid, counter, body, start=False, flags=None):
    """A transport packet by hand: header, adaptation field that fills it up, body."""
    fill = 184 - len(body)
    field = b"" if not fill and flags is None else bytes([fill - 1]) + (bytes([flags or 0]) + b"\xff" * (fill - 2) if fill > 1 else b"")
    return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if field else 0x10) | counter & 15]) + field + body


def unit(data, pts, size):
    stamp = bytes([0x21 | (pts >> 30 & 7) << 1, pts >> 22 & 255, (pts >> 15 & 127) << 1 | 1, pts >> 7 & 255, (pts & 127) << 1 | 1])
    return b"\x00\x00\x01\xe0" + size.to_bytes(2, "big") + b"\x80\x80\x05" + stamp + data


def table(kind, ident, body):
    head = bytes([kind]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + M.crc32_mpeg(head).to_bytes(4, "big")


def test_streams_of_other_origin():
    pat = table(0, 1, b"\x00\x01" + (0xE000 | 0x50).to_bytes(2, "big"))
    # a program table longer than a packet: a descriptor of 200 bytes, then two streams
    pmt = table(2, 1, b"\xe0\x61\xf0\xca\x05\xc8" + b"d" * 200 + b"\x1b\xe0\x60\xf0\x00" + b"\x0f\xe0\x61\xf0\x00")
    out = [packet(0, 0, b"\x00" + pat, True), packet(0x50, 0, b"\x00" + pmt[:183], True), packet(0x50, 1, pmt[183:])]
    video = [bytes([k]) * 300 for k in (1, 2, 3)]
    audio = [bytes([9 + k]) * 100 for k in range(3)]
    counter = 14
    for k in range(3):
        pes = unit(video[k], (1 << 32) + 3000 * k, 0)  # no size: up to the next unit
        first = packet(0x60, counter, pes[:180], True, 0x40 if k != 1 else 0x00)
        out += [first, first, packet(0x61, k, unit(audio[k], 7 * k, 8 + 100), True), packet(0x60, counter + 1, pes[180:])]
        counter += 2
    got = M.demux_all(b"".join(out))
    assert got[0x60].payload == b"".join(video) and got[0x61].payload == b"".join(audio) and not got[0x60].gaps and not got[0x60].damaged
    assert got[0x60].pts == [(1 << 32) + 3000 * k for k in range(3)] and got[0x60].random_access == [True, False, True] and got[0x60].offset == [0, 300, 600]
    other = list(out)
    other[4] = packet(0x60, 14, unit(b"x" * 160, 0, 0), True, 0x40)  # the counter repeats, the content does not
    assert M.demux_all(b"".join(other))[0x60].gaps


def test_media_errors(spark):
    good, bad = M.mux(b"a" * 500), M.mux(b"b" * 5000)
    rows = [(1, 500, good), (2, 1, b"x" * 188), (3, 5000, bad[: 188 * 4] + bad[188 * 6 :]), (4, 0, None), (5, 0, b"")]
    got = {r.doc_id: r for r in M.read_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1].error is None and got[1].payload_bytes == 500 and "sync" in got[2].error and got[2].payload_sha256 is None and "gaps" in got[3].error and got[4].error == "no stream" and got[5].error == "no program"


def test_media_rows(spark):
    rows = [(1, None), (2, ""), (3, "é" * 100), (4, "a" * 192), (5, "é" * 100), (None, "x" * 90_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(1))
    got = {r.doc_id: r for r in M.read_media(M.to_media(df)).collect()}
    for d, t in rows:
        n, p = M.padded(t)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r.media_sha256 == hashlib.sha256(M.mux(p)).hexdigest() and r.media_bytes == len(M.mux(p))
    assert got[3][2:] == got[5][2:] and M.read_media(M.to_media(df.limit(0))).collect() == []


@pytest.mark.skipif(not HAS_SF, reason="needs the generated tables")
def test_media_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = Q.op5_media_ts(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        n, p = M.padded(docs[r.doc_id])
        assert (r.n_bytes, r.payload_sha256) == (n, hashlib.sha256(p).hexdigest())


def member(head, block, end=b"\r\n\r\n"):
    import gzip

    return gzip.compress(b"WARC/1.0\r\n" + "\r\n".join(f"{k}: {v}" for k, v in head).encode() + f"\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + end)


def test_archives_of_other_origin(spark, tmp_path):
    import os

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    digest = "sha1:" + hashlib.sha1(b"hello").hexdigest()
    uuid = lambda k: f"<urn:uuid:0000-{k}>"
    parts = [
        member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", uuid(0)), ("Content-Type", "application/warc-fields")], b"software: x\r\n"),
        member([("warc-type", "request"), ("WARC-Record-ID", uuid(1)), ("WARC-Target-URI", "http://a/"), ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        member([("WARC-Type", "response"), ("WARC-Record-ID", uuid(2)), ("WARC-Target-URI", "http://a/"), ("Content-Type", "application/http; msgtype=response")], http + b"hello"),
        member([("WARC-Type", "response"), ("WARC-Record-ID", uuid(3)), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http")], http + b"hullo"),
        member([("WARC-Type", "metadata"), ("WARC-Record-ID", uuid(4)), ("X-Long", "a\r\n  b")], b""),
        member([("WARC-Type", "revisit"), ("WARC-Record-ID", uuid(5)), ("WARC-Payload-Digest", digest)], http),
        member([("WARC-Type", "response"), ("WARC-Record-ID", uuid(6)), ("Content-Type", "application/http")], http + os.urandom(9000)),
    ]

    def read(data, split):
        path = tmp_path / f"{hashlib.md5(data).hexdigest()}.warc.gz"
        path.write_bytes(data)
        return sorted(W.read_warc(spark.createDataFrame([(f"file://{path}", len(data))], "path string, size long"), split, payloads=True).collect(), key=lambda r: r.offset)

    for split in (1 << 20, 700, 64):
        got = read(b"".join(parts), split)
        assert [r.record_type for r in got] == ["warcinfo", "request", "response", "response", "metadata", "revisit", "response"]
        assert [r.record_id for r in got] == [uuid(k) for k in range(7)] and all(r.page_id is None for r in got)
        assert bytes(got[2].payload) == b"hello" and got[2].payload_digest == hashlib.sha1(b"hello").hexdigest() and got[2].error is None
        assert "contradicts" in got[3].error and got[5].payload is None and got[5].payload_digest == hashlib.sha1(b"hello").hexdigest()
        broken = bytearray(b"".join(parts))
        broken[sum(map(len, parts[:6])) + 5000] ^= 255
        cut = b"".join(parts)[:-100]
        for data in (bytes(broken), cut, b"".join(parts[:3]) + b"junk" * 9 + b"".join(parts[3:]), b"junk" + b"".join(parts)):
            errors = [r for r in read(data, split) if r.error and "contradicts" not in r.error]
            assert len(errors) == 1, (len(data), split)
    two = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 1\r\n\r\nx\r\n\r\n" * 2
    import gzip

    assert [r.payload_bytes for r in read(gzip.compress(two), 99)] == [1, 1]


def test_a_hot_payload_and_repeated_ids(spark):
    big = "x" * 1500
    rows = [(k, f"u{k}", big) for k in range(200)] + [(199, "again", big), (300, "u", big + "y"), (300, "u", "other")]
    got = W.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append((r.record_type, r.refers_to))
    assert len(got) == len(rows) and all(by[k] == [("revisit", 199)] for k in range(199)) and by[199] == [("response", None)] * 2 and by[300] == [("response", None)] * 2


def test_warc_splits(spark, tmp_path):
    big = "".join(chr(33 + i * i % 90) for i in range(3000))
    magic = b"\x1f\x8b\x08WARC/1.1".decode("latin1") * 50
    rows = [(1, "http://a", big), (2, None, big), (9, "http://b c", big), (3, "u", None), (4, "u", ""), (5, "u", ""), (6, "u", magic), (None, "u", big), (7, "u", "é" * 500), (8, "u", "é" * 500), (10, "u", "é" * 499)] + [(100 + i, "u", big[i:]) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    files = spark.createDataFrame(W.write_warc(df, f"file://{tmp_path}/w").collect(), "path string, size long")
    want = None
    for split in (1 << 30, 4096, 333):
        got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.read_warc(files, split).collect()), key=str)
        want = want or got
        assert got == want and len(got) == len(rows)
    by = {r[0]: r for r in want}
    assert by[1][3:] == by[2][3:] == ("revisit", 9) and by[9][3:] == by[0][3:] == ("response", None) and by[7][4] == 8 and by[10][3] == by[4][3] == by[5][3] == "response"
    for p, _, h in rows:
        assert by[p or 0][1:3] == (len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest())
    full = {r.page_id: r.payload for r in W.read_warc(files, 1000, payloads=True).collect()}
    assert full[6] == magic.encode() and full[1] is None and full[9] == big.encode()
    assert W.archive(df.limit(0)).collect() == []
