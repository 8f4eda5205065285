"""Recordings: one Parquet table for each entity and a manifest that is written last."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from sightline.functions.labels import LabelRegistry

FORMAT, VERSION = "sightline-recording", 1


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_recording(entities: dict[str, DataFrame], path: str, labels: LabelRegistry | None = None, metadata: dict | None = None, replace: bool = False) -> None:
    """A reader never sees half a recording: without its manifest a folder is none."""
    spark = next(iter(entities.values())).sparkSession
    fs, target = _fs(spark, f"{path}/manifest.json")
    if fs.exists(target):
        if not replace:
            raise FileExistsError(path)
        fs.delete(target, False)
    listed = {}
    for k, (entity, rows) in enumerate(sorted(entities.items())):
        rows.write.mode("overwrite").parquet(f"{path}/entity-{k:04d}")
        listed[entity] = {"table": f"entity-{k:04d}", "schema": json.loads(rows.schema.json())}
    text = json.dumps({"format": FORMAT, "version": VERSION, "entities": listed, "labels": labels and json.loads(labels.to_json()), "metadata": metadata or {}})
    out = fs.create(target, False)
    out.write(bytearray(text.encode()))
    out.close()


def read_recording(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], LabelRegistry | None, dict]:
    text = spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0]
    got = json.loads(text)
    if got.get("format") != FORMAT or got.get("version") != VERSION:
        raise ValueError(f"{path} is no recording of version {VERSION}")
    entities = {}
    for entity, x in got["entities"].items():
        if "/" in x["table"] or ".." in x["table"]:
            raise ValueError(f"{entity} points out of the recording")
        rows = spark.read.parquet(f"{path}/{x['table']}")
        said, found = ([(f.name, f.dataType.simpleString()) for f in kind] for kind in (StructType.fromJson(x["schema"]), rows.schema))
        if said != found:
            raise ValueError(f"{entity} has other columns than the manifest says: {found}")
        entities[entity] = rows
    labels = LabelRegistry.from_json(json.dumps(got["labels"])) if got["labels"] else None
    return entities, labels, got["metadata"]
