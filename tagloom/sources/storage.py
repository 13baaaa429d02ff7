"""Folders that driver and executors share, and versions of a table that appear whole or not at all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir; without that, in a temporary folder where all runs on one machine."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tagloom-")
        sc.setCheckpointDir(at)
    return f"{at.rstrip('/')}/kept-{uuid.uuid4().hex}"


class Folder:
    """A folder on any file system that Spark reads. Only names are handled here; rows are Spark's."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")

    def _fs(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}" if name else self.at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def names(self, name: str = "") -> list[str]:
        fs, path = self._fs(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def rename(self, old: str, new: str) -> None:
        """Fails if `new` exists: what has been published stays as it is."""
        (fs, a), (_, b) = self._fs(old), self._fs(new)
        fs.mkdirs(b.getParent())
        if fs.exists(b) or not fs.rename(a, b):
            raise FileExistsError(f"{b} is there already, or {a} is not")

    def delete(self, name: str) -> None:
        fs, path = self._fs(name)
        fs.delete(path, True)


class Versions:
    """Versions 1, 2, ... of a set of small tables below `at`/versions. Readers take the highest; a version appears by one rename.

    One writer at a time: a second one that publishes the same number gets an
    error, and what it wrote is seen by nobody.
    """

    def __init__(self, spark: SparkSession, at: str):
        self.folder = Folder(spark, at)

    def latest(self) -> int:
        """0 before the first."""
        return max((int(n) for n in self.folder.names("versions") if n.isdecimal()), default=0)

    def publish(self, version: int, **tables: DataFrame) -> None:
        draft = f"drafts/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.folder.at}/{draft}/{name}")
        self.folder.rename(draft, f"versions/{version}")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        version = self.latest() if version is None else version
        return self.folder.spark.read.parquet(f"{self.folder.at}/versions/{version}/{name}")
