"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """A folder of intermediate tables below ``spark.checkpoint.dir``.

    Without that setting a local session writes to a folder that goes when the process ends; on a
    cluster that raises, since executors do not see each other's disks.
    """

    _own: str | None = None

    def __init__(self, spark: SparkSession, kind: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            if Scratch._own is None:
                Scratch._own = tempfile.mkdtemp(prefix="scratch-")
                atexit.register(shutil.rmtree, Scratch._own, ignore_errors=True)
            base = f"file://{Scratch._own}"
        self.spark, self.path = spark, f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex[:12]}"

    def put(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """Write ``df`` and return the table just written; this cuts the lineage."""
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{name}")
        return self.get(name, df.schema)

    def get(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema else reader).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that are no longer read (all of them without names)."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame, kind: str = "table") -> DataFrame:
    """``df`` as a table written once, for what reads it several times."""
    return Scratch(df.sparkSession, kind).put(df, "0")
