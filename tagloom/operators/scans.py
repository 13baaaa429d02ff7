"""Scans of a library's folder tree: listed in tasks, compared with what is known, and published as one version of all tables.

A scan asks for the time of every folder that is known, many at once, and opens
those alone that have changed or are new; what it finds below them goes into the
next round. Folders that cannot be read are rows of `errors`; what is known of
them stays, and the next scan tries again. The listing is written once, all
outputs are made of it, and they appear together by one rename: readers see the
tables before the scan or after it.

The tree must be reachable by the same path from all executors, as a mount is.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import AUDIO
from ..sources.storage import Folder, Versions
from .files import parent
from .matching import moves

LISTED = "folder string, kind string, path string, size long, modified_ms long, note string"
FILES = "file_id long, normalized_path string, file_size long, modified_ms long, fingerprint string, duration double"
FOLDERS = "folder string, mtime long, file_count long"
CHANGES = "status string, normalized_path string, old_path string, file_id long"


def _open(root: str, folder: str, was: int | None) -> list[tuple]:
    """What one folder holds: a row of its own (same, listed, gone or error), and one for each folder and audio file in it."""
    at = os.path.join(root, folder)
    try:
        # the time is taken first, so that what changes meanwhile is found by the next scan
        mtime = int(os.stat(at).st_mtime * 1000)
        if was == mtime:
            return [(folder, "same", folder, None, mtime, None)]
        rows, n = [], 0
        with os.scandir(at) as entries:
            for e in entries:
                path = f"{folder}/{e.name}" if folder else e.name
                if e.is_dir(follow_symlinks=False):
                    rows.append((folder, "folder", path, None, None, None))
                elif e.name.rpartition(".")[2].lower() in AUDIO and "." in e.name and e.is_file():
                    try:
                        s = e.stat()
                    except OSError as x:
                        rows.append((folder, "error", path, None, None, str(x)))
                        continue
                    rows.append((folder, "file", path, s.st_size, int(s.st_mtime * 1000), None))
                    n += 1
        return [*rows, (folder, "listed", folder, n, mtime, None)]
    except FileNotFoundError:
        return [(folder, "gone", folder, None, None, None)]
    except OSError as x:
        return [(folder, "error", folder, None, None, str(x))]


def _lister(root: str):
    names = [c.split()[0] for c in LISTED.split(", ")]
    kinds = [pa.int64() if c.endswith("long") else pa.string() for c in LISTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, was in zip(batch.column("folder").to_pylist(), batch.column("mtime").to_pylist(), strict=True):
                # a folder at a time: what is held is what one folder holds
                rows = _open(root, folder, was)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def list_tree(spark: SparkSession, root: str, known: DataFrame, at: str) -> DataFrame:
    """The rows of LISTED of the tree below `root`, written below `at`; known folders (folder, mtime) whose time is theirs are not opened.

    A round lists what the one before found; there are as many as new folders lie within each other, and one for all that is known.
    """
    tasks = spark.sparkContext.defaultParallelism
    start = spark.createDataFrame([("", None)], "folder string, mtime long")
    due = known.select("folder", "mtime").where("folder <> ''").union(known.select("folder", "mtime").where("folder = ''").union(start).groupBy("folder").agg(F.max("mtime").alias("mtime")))
    seen, n = known.select("folder"), 0
    while True:
        due.repartition(tasks).mapInArrow(_lister(root), LISTED).write.mode("overwrite").parquet(f"{at}/round={n}")
        found = spark.read.schema(LISTED).parquet(f"{at}/round={n}").where("kind = 'folder'").select(F.col("path").alias("folder"))
        new = found.join(seen, "folder", "left_anti").distinct()
        if new.isEmpty():
            break
        due, seen, n = new.withColumn("mtime", F.lit(None).cast("long")), seen.union(new), n + 1
    return spark.read.schema(f"{LISTED}, round int").parquet(at).drop("round")


def compare(known: DataFrame, listing: DataFrame) -> DataFrame:
    """status (same, changed, new, missing) of each file of a folder that was opened or is gone: one full join by path.

    `known` has the columns of FILES. Files of folders that are as they were, or could not be read, are not among them.
    """
    about = listing.where("kind IN ('listed', 'gone')").select("folder").distinct()
    # a folder within one that is gone is gone too, whether it was asked for or not
    unread = listing.where("kind = 'error'").select(F.col("path").alias("normalized_path"))
    was = known.withColumn("folder", parent(F.col("normalized_path"))).join(about, "folder", "left_semi").join(unread, "normalized_path", "left_anti")
    now = listing.where("kind = 'file'").select(F.col("path").alias("normalized_path"), F.col("size").alias("new_size"), F.col("modified_ms").alias("new_ms"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("new_ms").isNull(), "missing").when(F.col("modified_ms") == F.col("new_ms"), "same").otherwise("changed")
    both = was.drop("folder").withColumn("was", F.lit(True)).join(now, "normalized_path", "full")
    return both.withColumn("status", status).drop("was")


def with_moves(compared: DataFrame, described: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """The changes (CHANGES) of a comparison: a missing and a new file of the same fingerprint (`described` has normalized_path, fingerprint and duration of new ones) are one that moved."""
    gone = compared.where("status = 'missing'").select("file_id", F.col("normalized_path").alias("path"), "fingerprint", "duration")
    come = compared.where("status = 'new'").select("normalized_path").join(described, "normalized_path").select(F.col("normalized_path").alias("path"), "fingerprint", "duration")
    moved = moves(gone, come, tolerance)
    here = moved.select("file_id", "old_path", F.col("new_path").alias("normalized_path"))
    rest = compared.where("status = 'changed'").select("status", "normalized_path", F.lit(None).cast("string").alias("old_path"), "file_id")
    left = compared.where("status = 'missing'").join(moved.select("file_id"), "file_id", "left_anti").select("status", "normalized_path", F.lit(None).cast("string").alias("old_path"), "file_id")
    new = compared.where("status = 'new'").join(here.select("normalized_path"), "normalized_path", "left_anti").select("status", "normalized_path", F.lit(None).cast("string").alias("old_path"), F.lit(None).cast("long").alias("file_id"))
    return rest.union(left).union(new).union(here.select(F.lit("moved").alias("status"), "normalized_path", "old_path", "file_id"))


def files_after(known: DataFrame, compared: DataFrame, changes: DataFrame, described: DataFrame) -> DataFrame:
    """The files (FILES) after these changes, which name each file but new ones by file_id; new ones must have been given theirs."""
    columns = [c.split()[0] for c in FILES.split(", ")]
    stay = known.join(changes.where("status <> 'new'").select("file_id"), "file_id", "left_anti")
    now = compared.where("new_ms IS NOT NULL").select("normalized_path", F.col("new_size").alias("file_size"), F.col("new_ms").alias("modified_ms"))
    held = known.select("file_id", F.col("fingerprint").alias("was_print"), F.col("duration").alias("was_duration"))
    come = changes.where("status <> 'missing'").select("file_id", "normalized_path", "status").join(now, "normalized_path").join(described, "normalized_path", "left").join(held, "file_id", "left")
    said = lambda c, was: F.coalesce(c, F.when(F.col("status") == "moved", F.col(was))).alias(c)
    return stay.select(*columns).union(come.select("file_id", "normalized_path", "file_size", "modified_ms", said("fingerprint", "was_print"), said("duration", "was_duration")))


Describe = Callable[[DataFrame], DataFrame]


class Library:
    """A folder tree and the tables that scans of it keep in `store`: files, folders, and the last scan's changes and errors."""

    def __init__(self, spark: SparkSession, root: str, store: str):
        self.spark, self.root = spark, root.rstrip("/") or "/"
        self.versions, self.folder = Versions(spark, store), Folder(spark, store)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        version = self.versions.latest() if version is None else version
        schema = {"files": FILES, "folders": FOLDERS, "changes": CHANGES, "errors": "path string, note string"}[name]
        if not version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder.at}/versions/{version}/{name}")

    def scan(self, full: bool = False, describe: Describe | None = None) -> int:
        """Scans and publishes; returns the version, the last one if nothing has changed and nothing failed.

        A full scan opens every folder. `describe` gives normalized_path,
        fingerprint and duration of files that are new or changed; without it no
        file is known by what it holds, and a moved file is a missing and a new one.
        """
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"{self.root} is no folder that can be read: nothing is taken for missing")
        version = self.versions.latest()
        files, folders = self.table("files", version), self.table("folders", version)
        draft = f"drafts/scan-{version + 1}"
        at = f"{self.folder.at}/{draft}"
        asked = folders.withColumn("mtime", F.lit(None).cast("long")) if full else folders
        self.folder.delete(draft)
        listing = list_tree(self.spark, self.root, asked, f"{at}/listing")
        errors = listing.where("kind = 'error'").select("path", "note")
        compare(files, listing).write.parquet(f"{at}/compared")
        compared = self.spark.read.parquet(f"{at}/compared")
        # the time of a folder changes with folders in it too, so that its row may be new where no file is
        touched = listing.where("kind IN ('listed', 'gone')").select("folder")
        kept = folders.join(touched, "folder", "left_anti")
        opened = listing.where("kind = 'listed'").select("folder", F.col("modified_ms").alias("mtime"), F.col("size").alias("file_count"))
        now = kept.select("folder", "mtime", "file_count").union(opened)
        if version and compared.where("status <> 'same'").isEmpty() and errors.isEmpty() and now.exceptAll(folders).isEmpty() and folders.exceptAll(now).isEmpty():
            self.folder.delete(draft)
            return version
        fresh = compared.where("status IN ('new', 'changed')").select("normalized_path")
        none = fresh.limit(0).select("normalized_path", F.lit(None).cast("string").alias("fingerprint"), F.lit(None).cast("double").alias("duration"))
        (describe(fresh) if describe else none).select("normalized_path", "fingerprint", "duration").write.parquet(f"{at}/described")
        described = self.spark.read.parquet(f"{at}/described")
        largest = files.agg(F.coalesce(F.max("file_id"), F.lit(0))).first()[0]
        # written once: a number that a task gives is not given again
        given = F.when(F.col("status") == "new", F.monotonically_increasing_id() + largest + 1).otherwise(F.col("file_id"))
        with_moves(compared, described).withColumn("file_id", given).write.parquet(f"{at}/changes")
        changes = self.spark.read.schema(CHANGES).parquet(f"{at}/changes")
        self.versions.publish(version + 1, files=files_after(files, compared, changes, described), folders=now, changes=changes, errors=errors)
        self.folder.delete(draft)
        return version + 1

    def counts(self, version: int | None = None) -> dict[str, int]:
        """How many files the scan found new, changed, moved and missing, and how many errors."""
        found = {r.status: r["count"] for r in self.table("changes", version).groupBy("status").count().collect()}
        return {s: found.get(s, 0) for s in ("new", "changed", "moved", "missing")} | {"errors": self.table("errors", version).count()}
