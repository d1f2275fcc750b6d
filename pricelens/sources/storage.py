"""The shared work folder, and tables written and replaced there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without it (tests) gets one of its own, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pricelens-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def folders(spark: SparkSession, path: str) -> list:
    """The folders in a folder, none if there is no such folder; no file is opened."""
    at, fs = _path(spark, path)
    return [s.getPath() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


class VersionedTable:
    """A table that is replaced as a whole: each version is a folder of its own, and readers take the last complete one.

    Spark marks a folder complete by _SUCCESS. Writing a version twice, as a retried batch does, replaces it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        found = [p for p in folders(self.spark, self.path) if p.getName().startswith("v=") and exists(self.spark, f"{p}/_SUCCESS")]
        return sorted(int(p.getName()[2:]) for p in found)

    def read(self, before: int | None = None) -> DataFrame | None:
        """The last version, or the last one before a given one; None if there is none."""
        found = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/v={found[-1]}") if found else None

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
