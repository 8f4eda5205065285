"""Byte columns as MPEG transport streams, and back.

A payload is cut into access units, each a PES packet with a time stamp, carried in 188-byte packets
on one PID.  Program tables precede every random-access point.  Reading parses the tables (their
CRC is checked), follows the continuity counters, reassembles the PES packets and returns their
time stamps with the random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from sightline.llm.common import chunks

#: Fixed values of the format, and the PIDs used when writing.
SYNC, SIZE, PAT_PID, PMT_PID, ES_PID, STREAM_ID, STREAM_TYPE = 0x47, 188, 0, 0x1000, 0x100, 0xBD, 0x06
#: Bytes of an access unit (20 groups of 192), ticks of 1/90000 s between units, units between random-access points.
UNIT, TICKS, GROUP = 3840, 3600, 8


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _table(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return b"\x00" + head + crc32_mpeg(head).to_bytes(4, "big")  # after the pointer field


_PAT = _table(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _table(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15]) + section).ljust(SIZE, b"\xff")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1])


def mux(payload: bytes) -> bytes:
    """A transport stream that carries ``payload``."""
    out, counter, tables = [], 0, 0
    for k in range(0, max(1, -(-len(payload) // UNIT))):
        unit, pts, extra = payload[k * UNIT : (k + 1) * UNIT], k * TICKS & (1 << 33) - 1, b""
        if k % GROUP == 0:
            out += [_table_packet(PAT_PID, _PAT, tables), _table_packet(PMT_PID, _PMT, tables)]
            tables += 1
            extra = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big")  # random access, clock reference
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit
        at = 0
        while at < len(pes):
            room = 184 - (len(extra) + 1 if extra else 0)
            part = pes[at : at + room]
            head = bytes([SYNC, (0x40 if at == 0 else 0) | ES_PID >> 8, ES_PID & 255])
            if extra or len(part) < 184:
                body = extra or (b"\x00" if len(part) < 183 else b"")
                body = body.ljust(183 - len(part), b"\xff")
                out.append(head + bytes([0x30 | counter, len(body)]) + body + part)
            else:
                out.append(head + bytes([0x10 | counter]) + part)
            counter, at, extra = counter + 1 & 15, at + len(part), b""
    return b"".join(out)


@dataclass
class Stream:
    """What an elementary stream holds: the payload and, for each unit, its stamp and place.

    ``gaps`` counts places where packets were lost; ``damaged`` are the units that lack bytes.
    """

    payload: bytes = b""
    pts: list[int | None] = field(default_factory=list)
    random_access: list[bool] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    gaps: int = 0
    damaged: list[int] = field(default_factory=list)


def _section(pid: int, section: bytes, pmts: dict[int, int], streams: dict[int, int]) -> None:
    if crc32_of(section):
        raise ValueError(f"damaged table on PID {pid}")
    if section[0] == 0 and pid == PAT_PID:
        for i in range(8, len(section) - 4, 4):
            if program := section[i] << 8 | section[i + 1]:
                pmts[(section[i + 2] & 31) << 8 | section[i + 3]] = program
    elif section[0] == 2:
        i = 12 + ((section[10] & 15) << 8 | section[11])
        while i < len(section) - 4:
            streams.setdefault((section[i + 1] & 31) << 8 | section[i + 2], section[i])
            i += 5 + ((section[i + 3] & 15) << 8 | section[i + 4])


class _Tables:
    """Program tables, which may be longer than a packet or several to one."""

    def __init__(self):
        self.pmts: dict[int, int] = {}
        self.streams: dict[int, int] = {}
        self.open: dict[int, bytes] = {}

    def add(self, pid: int, start: bool, body: bytes) -> None:
        if start:
            if self.open.get(pid) and body[0]:
                self._take(pid, self.open[pid] + body[1 : 1 + body[0]])
            self._take(pid, body[1 + body[0] :])
        elif self.open.get(pid):
            self._take(pid, self.open[pid] + body)

    def _take(self, pid: int, data: bytes) -> None:
        while len(data) >= 3 and data[0] != 0xFF:
            size = 3 + ((data[1] & 15) << 8 | data[2])
            if len(data) < size:
                break
            _section(pid, data[:size], self.pmts, self.streams)
            data = data[size:]
        self.open[pid] = b"" if data[:1] == b"\xff" else data


_KNOWN: dict[bytes, int] = {}


def crc32_of(section: bytes) -> int:
    """0 for a whole section; remembered, as tables repeat."""
    if section not in _KNOWN:
        if len(_KNOWN) > 100:
            _KNOWN.clear()
        _KNOWN[section] = crc32_mpeg(section)
    return _KNOWN[section]


def demux_all(media: bytes) -> dict[int, Stream]:
    """The elementary streams of a transport stream, by PID.

    A packet sent twice, byte for byte, counts once, as the format allows; any other break of a
    continuity counter that is not announced is a gap.  A unit's size is what its head says, or, if
    it says none, what comes before the next unit.  Raises ValueError for lost synchronisation, damaged
    tables and units without a start code.
    """
    if len(media) % SIZE:
        raise ValueError("not whole packets")
    tables, last = _Tables(), {}
    units: dict[int, list[list]] = {}
    gaps: dict[int, int] = {}
    for at in range(0, len(media), SIZE):
        if media[at] != SYNC:
            raise ValueError(f"no sync byte at {at}")
        if media[at + 1] & 0x80:
            raise ValueError(f"a transport error at {at}")
        start, control = bool(media[at + 1] & 0x40), media[at + 3]
        pid, first, access, jump = (media[at + 1] & 31) << 8 | media[at + 2], at + 4, False, False
        if control & 0x20:
            first += 1 + media[at + 4]
            if media[at + 4]:
                access, jump = bool(media[at + 5] & 0x40), bool(media[at + 5] & 0x80)
        if not control & 0x10 or pid == 0x1FFF:
            continue
        packet, lost = media[at : at + SIZE], False
        if pid in last and not jump:
            before = last[pid]
            if packet == before:
                continue
            lost = control & 15 != (before[3] + 1) & 15
        last[pid] = packet
        if lost:
            gaps[pid] = gaps.get(pid, 0) + 1
        if pid == PAT_PID or pid in tables.pmts:
            tables.add(pid, start, media[first : at + SIZE])
        elif pid in tables.streams:
            mine = units.setdefault(pid, [])
            if lost and mine:
                mine[-1][2] = True
            if start:
                mine.append([access, [], False])
            if mine:
                mine[-1][1].append(media[first : at + SIZE])
    return {pid: _stream(units.get(pid, []), gaps.get(pid, 0)) for pid in sorted(tables.streams)}


def _stream(units: list[list], gaps: int) -> Stream:
    got, parts, total = Stream(gaps=gaps), [], 0
    for k, (access, packets, lost) in enumerate(units):
        pes = b"".join(packets)
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 9 + pes[8]:
            raise ValueError("no start code")
        size = int.from_bytes(pes[4:6], "big")
        if lost or size and len(pes) < 6 + size:
            got.damaged.append(k)
        s = pes[9:14]
        got.pts.append((s[0] & 14) << 29 | s[1] << 22 | (s[2] & 254) << 14 | s[3] << 7 | s[4] >> 1 if pes[7] & 0x80 else None)
        got.random_access.append(access)
        got.offset.append(total)
        parts.append(pes[9 + pes[8] : 6 + size if size else len(pes)])
        total += len(parts[-1])
    got.payload = b"".join(parts)
    return got


def demux(media: bytes) -> Stream:
    """The elementary stream of the lowest PID; see :func:`demux_all`."""
    streams = demux_all(media)
    if not streams:
        raise ValueError("no program")
    return next(iter(streams.values()))


def padded(text: str | None) -> tuple[int, bytes]:
    """(size, payload): the UTF-8 text with spaces up to a positive multiple of 192 bytes."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): each text as a transport stream.

    Null and empty texts are 192 spaces; equal texts give equal streams; null ids and repeated rows
    are kept; other columns are left out; an empty table gives none.
    """
    docs = docs.select(id_col, F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sizes, media = zip(*((n, mux(p)) for n, p in map(padded, part.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    return docs.mapInArrow(run, StructType(docs.select(id_col).schema.fields[:]).add("n_bytes", "long").add("media", "binary"))


#: What reading a stream gives; a stream that cannot be read gives ``error`` and nulls.
READ = (("payload_bytes", "long", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "long", pa.int64()), ("media_bytes", "long", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string()), ("pts", ArrayType(LongType()), pa.list_(pa.int64())), ("offset", ArrayType(LongType()), pa.list_(pa.int64())), ("random_access_pts", ArrayType(LongType()), pa.list_(pa.int64())), ("error", "string", pa.string()))


def read_one(m: bytes | None) -> tuple:
    """The values of ``READ`` for one stream."""
    if m is None:
        return (*[None] * 9, "no stream")
    sizes = len(m), hashlib.sha256(m).hexdigest()
    try:
        s = demux(m)
    except (ValueError, IndexError) as bad:
        return None, None, None, *sizes, None, None, None, None, str(bad)
    p = np.frombuffer(s.payload, np.uint8)
    bins = np.bincount(p >> 5, minlength=8).tolist()
    feature = f"units={len(s.pts)} points={sum(s.random_access)} last={s.pts[-1] if s.pts else None} gaps={s.gaps} mean={int(p.sum()) / max(1, len(p)):.6f} bins={','.join(map(str, bins))}"
    points = [t for t, a in zip(s.pts, s.random_access) if a]
    error = f"{s.gaps} gaps, damaged units {s.damaged}" if s.gaps or s.damaged else None
    return len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), *sizes, feature, s.pts, s.offset, points, error


def read_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests, units and a feature string of ``media(id_col, n_bytes, media)``, from the stored bytes.

    feature: units, random-access points, last time stamp, lost packets, mean byte and the counts of
    bytes by their upper three bits.  ``pts`` and ``offset`` (into the payload) are those of all units.
    Lost packets and units that lack bytes are told in ``error``; a stream that cannot be read has
    nulls and ``error``, and other rows are not affected.
    """
    schema = StructType(media.select(id_col, "n_bytes").schema.fields[:])
    for name, kind, _ in READ:
        schema = schema.add(name, kind)
    names = [n for n, _, _ in READ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*map(read_one, batch.column("media").to_pylist()))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("n_bytes"), *(pa.array(x, k) for x, (_, _, k) in zip(got, READ))], [id_col, "n_bytes", *names])

    return media.select(id_col, "n_bytes", "media").mapInArrow(run, schema)
