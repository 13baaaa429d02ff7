"""Changes of files as a stream: a scan of a library when its changes have paused."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import Folder


def due_scans(changes: DataFrame, quiet: str = "2 seconds", delay: str = "1 second") -> DataFrame:
    """library_id, began, scan_at and n_changes of each burst of a stream of changes (library_id, ts), in append mode.

    A burst is a session window: it ends when no change came for `quiet`, and is
    reported once the watermark, `delay` behind the latest change, has passed
    that. State is one row for each open burst of a library, however many
    changes it has. A change that comes after its burst was reported is late and
    dropped; the scan that was due began after it.
    """
    timed = changes.where("library_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    bursts = timed.groupBy("library_id", F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("n_changes"))
    return bursts.select("library_id", F.col("w.start").alias("began"), F.col("w.end").alias("scan_at"), "n_changes")


def trigger_scans(changes: DataFrame, scan: Callable[[list, int], None], folder: Folder, checkpoint: str, quiet: str = "2 seconds", delay: str = "1 second"):
    """A writer that calls `scan` with the libraries that are due in a batch, and the batch's number.

    A mark in `folder` is set after the call, so that a batch which runs again
    after a failure elsewhere does not scan again; only if the driver is lost
    within the call itself is it made twice. Libraries are few: one row each.
    """

    def run(due: DataFrame, batch: int) -> None:
        libraries = sorted(r.library_id for r in due.select("library_id").distinct().collect())
        if not libraries or f"batch={batch}" in folder.names("scanned"):
            return
        scan(libraries, batch)
        due.sparkSession.createDataFrame([(x,) for x in libraries], due.select("library_id").schema).coalesce(1).write.mode("overwrite").parquet(f"{folder.at}/scanned/batch={batch}")

    return due_scans(changes, quiet, delay).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(run)
