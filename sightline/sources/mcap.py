"""Bag containers (MCAP) and their CDR messages, decoded to the JSON rows that :mod:`bags` takes.

Fixed values of the formats: the magic, record numbers and sizes of primitive types.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"\x89MCAP0\r\n"
SCHEMA, CHANNEL, MESSAGE, CHUNK = 3, 4, 5, 6
#: struct letters of primitive types.
PRIMITIVE = {"bool": "?", "byte": "B", "char": "B", "int8": "b", "uint8": "B", "int16": "h", "uint16": "H", "int32": "i", "uint32": "I", "int64": "q", "uint64": "Q", "float32": "f", "float64": "d"}
BUILTIN = {"builtin_interfaces/Time": "int32 sec\nuint32 nanosec", "builtin_interfaces/Duration": "int32 sec\nuint32 nanosec"}
KINDS = {"DetectedObjects": "detected", "TrackedObjects": "tracked", "PredictedObjects": "predicted", "TFMessage": "tf"}


def _text(data: bytes, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from("<I", data, at)
    return data[at + 4 : at + 4 + n].decode(), at + 4 + n


def _records(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 9 <= len(data):
        kind, size = struct.unpack_from("<BQ", data, at)
        if at + 9 + size > len(data):
            raise ValueError("a record is cut off")
        yield kind, data[at + 9 : at + 9 + size]
        at += 9 + size


def _plain(kind: str, data: bytes) -> bytes:
    if kind == "":
        return data
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if kind == "lz4":
        return pa.CompressedInputStream(pa.BufferReader(data), "lz4").read()
    raise ValueError(f"unknown compression {kind!r}")


def messages(data: bytes) -> Iterator[tuple[str, str, str, int, bytes]]:
    """(topic, schema name, schema text, log time, CDR bytes) of a container, in the order written."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("no MCAP container")
    end = len(data) - len(MAGIC) if data.endswith(MAGIC) and len(data) >= 2 * len(MAGIC) else len(data)
    schemas: dict[int, tuple[str, str]] = {}
    channels: dict[int, tuple[str, int]] = {}

    def walk(part: bytes) -> Iterator[tuple[str, str, str, int, bytes]]:
        for kind, body in _records(part):
            if kind == SCHEMA:
                (ident,) = struct.unpack_from("<H", body)
                name, at = _text(body, 2)
                _, at = _text(body, at)
                schemas[ident] = name, _text(body, at)[0]
            elif kind == CHANNEL:
                ident, of = struct.unpack_from("<HH", body)
                channels[ident] = _text(body, 4)[0], of
            elif kind == MESSAGE:
                ident, _, time = struct.unpack_from("<HIQ", body)
                topic, of = channels[ident]
                yield topic, *schemas[of], time, body[22:]
            elif kind == CHUNK:
                compression, at = _text(body, 28)
                (size,) = struct.unpack_from("<Q", body, at)
                yield from walk(_plain(compression, body[at + 8 : at + 8 + size]))

    yield from walk(data[len(MAGIC) : end])


@lru_cache(64)
def fields(name: str, text: str) -> dict[str, list[tuple[str, str, str | None]]]:
    """Fields (type, name, array) of a message type and of all that it names, from a schema's text."""
    out: dict[str, list] = {}
    parts = re.split(r"(?m)^=+\s*\n", text)
    for i, part in enumerate(parts):
        head = re.match(r"MSG: (\S+)\n?", part)
        own = name if i == 0 else head[1] if head else ""
        out[_short(own)] = _lines(part[head.end() :] if head else part)
    for key, body in BUILTIN.items():
        out.setdefault(key, _lines(body))
    return out


def _short(name: str) -> str:
    return name.replace("/msg/", "/")


def _lines(text: str) -> list[tuple[str, str, str | None]]:
    found = []
    for line in text.split("\n"):
        line = line.split("#")[0].strip()
        if got := re.match(r"([\w/]+(?:<=\d+)?)(\[[^\]]*\])?\s+(\w+)\s*(=)?", line):
            if not got[4]:  # no constant
                found.append((_short(got[1].split("<=")[0]), got[3], got[2]))
    return found


class Cdr:
    """Reads one message; values are aligned to their size, counted from after the 4-byte head."""

    def __init__(self, data: bytes, types: dict):
        self.data, self.types, self.at = data[4:], types, 0
        self.order = "<" if data[1] & 1 else ">"

    def number(self, letter: str):
        size = struct.calcsize(letter)
        self.at += -self.at % size
        (value,) = struct.unpack_from(self.order + letter, self.data, self.at)
        self.at += size
        return value

    def value(self, kind: str, package: str):
        if kind in PRIMITIVE:
            return self.number(PRIMITIVE[kind])
        if kind == "string":
            n = self.number("I")
            text = self.data[self.at : self.at + max(0, n - 1)].decode()
            self.at += n
            return text
        return self.message(kind if "/" in kind else f"{package}/{kind}")

    def message(self, name: str) -> dict:
        name = name if name in self.types else next((t for t in self.types if t.rpartition("/")[2] == name.rpartition("/")[2]), name)
        package, out = name.rpartition("/")[0], {}
        for kind, field, array in self.types[name]:
            if array is None:
                out[field] = self.value(kind, package)
            else:
                n = int(array[1:-1]) if array[1:-1].isdigit() else self.number("I")
                out[field] = [self.value(kind, package) for _ in range(n)]
        return out


def decode(name: str, text: str, data: bytes) -> dict:
    return Cdr(data, fields(name, text)).message(_short(name))


def kind_of(schema: str) -> str | None:
    """detected, tracked, predicted or tf, by the name of a message type; None for others."""
    return KINDS.get(schema.rpartition("/")[2])


def plain(message: dict, kind: str) -> dict:
    """A message of objects in the shape that :mod:`bags` takes; transforms are in it already."""
    if kind == "tf":
        return message
    out = []
    for o in message["objects"]:
        k = o["kinematics"]
        at = k.get("initial_pose_with_covariance") or k["pose_with_covariance"]
        speed = k.get("initial_twist_with_covariance") or k.get("twist_with_covariance")
        paths = [{"confidence": p["confidence"], "time_step_ns": p["time_step"]["sec"] * 10**9 + p["time_step"]["nanosec"], "path": p["path"]} for p in k.get("predicted_paths", [])]
        shape = {"type": o["shape"]["type"], "dimensions": o["shape"]["dimensions"]}
        motion = {"pose": at["pose"], "twist": speed and speed["twist"]["linear"], "has_twist": k.get("has_twist", True), "paths": paths}
        out.append({"existence_probability": o["existence_probability"], "classification": o["classification"], "shape": shape, "kinematics": motion, "object_id": o.get("object_id")})
    return {"header": message["header"], "objects": out}


def read_bags(spark: SparkSession, path: str, topics: list[str] | None = None, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """(topic, kind, stamp_ns, message) of the containers in ``path``, messages as JSON.

    A recorder splits long bags; each file is one task's and is read whole (2 GB at most).  Only
    messages of known kinds, of ``topics`` and of [start_ns, end_ns) by log time are decoded.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mcap").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for topic, name, text, time, data in messages(content.as_py()):
                    kind = kind_of(name)
                    if kind is None or topics is not None and topic not in topics or start_ns is not None and time < start_ns or end_ns is not None and time >= end_ns:
                        continue
                    rows.append((topic, kind, time, json.dumps(plain(decode(name, text, data), kind))))
                    if len(rows) == 1000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(run, "topic string, kind string, stamp_ns long, message string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.string()))], ["topic", "kind", "stamp_ns", "message"])


def topics_of(spark: SparkSession, path: str) -> DataFrame:
    """(topic, kind, messages) of the containers in ``path``."""
    return read_bags(spark, path).groupBy("topic", "kind").count().withColumnRenamed("count", "messages")
