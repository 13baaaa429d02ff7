"""File queries: search, statistics, folders, and the diff of two scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search(files: DataFrame, text: str | None = None, artist: str | None = None, album: str | None = None) -> DataFrame:
    found = files
    if text:
        like = f"%{text.lower()}%"
        found = found.where(F.lower("artist").like(like) | F.lower("album").like(like) | F.lower("title").like(like))
    if artist:
        found = found.where(F.col("artist") == artist)
    if album:
        found = found.where(F.col("album") == album)
    return found


def overview(files: DataFrame) -> DataFrame:
    """One row: counts, floor of the milliseconds, bytes, and the mean with a guard for none."""
    n = F.count("*")
    ms = F.floor(F.sum("duration_seconds") * 1000).cast("long")
    return files.agg(n.alias("n_files"), F.countDistinct("artist").alias("artists"), F.countDistinct("album").alias("albums"), F.coalesce(ms, F.lit(0)).alias("total_ms"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"), F.when(n > 0, F.round(F.sum("duration_seconds") * 1000 / n, 3)).otherwise(0.0).alias("avg_ms"))


def per_library(files: DataFrame) -> DataFrame:
    folder = F.regexp_replace("normalized_path", r"/[^/]*$", "")
    return files.groupBy("library_id").agg(F.count("*").alias("n_files"), F.countDistinct(folder).alias("n_folders"))


def in_folder(files: DataFrame, folder: str) -> DataFrame:
    """The root has the files without a slash; any other folder those below it."""
    return files.where(F.instr("normalized_path", "/") == 0) if not folder else files.where(F.col("normalized_path").startswith(folder + "/"))


def frequencies(files: DataFrame, column: str) -> DataFrame:
    return files.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_files"))


def scan_diff(known: DataFrame, seen: DataFrame) -> DataFrame:
    """normalized_path and what a scan does with it: new, changed (size), same or missing. One full outer equi-join."""
    k, s = known.select("normalized_path", F.col("file_size").alias("was")), seen.select("normalized_path", F.col("file_size").alias("is"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "missing").when(F.col("was") != F.col("is"), "changed").otherwise("same")
    return k.join(s, "normalized_path", "full").select("normalized_path", status.alias("status"))


def m3u(files: DataFrame) -> DataFrame:
    """The lines of a playlist, in the order of file_id; a missing duration is -1, a missing title the file's name."""
    title = F.coalesce("title", F.element_at(F.split("normalized_path", "/"), -1))
    return files.select("file_id", F.concat(F.lit("#EXTINF:"), F.coalesce(F.floor("duration_seconds"), F.lit(-1)).cast("string"), F.lit(","), F.coalesce("artist", F.lit("Unknown Artist")), F.lit(" - "), title).alias("info"), F.col("normalized_path").alias("path"))


def folders(files: DataFrame) -> DataFrame:
    """Each folder that holds files, its number of files and total size (a stand-in for its time of change)."""
    return files.groupBy(F.regexp_replace("normalized_path", r"/[^/]*$", "").alias("folder")).agg(F.count("*").alias("file_count"), F.sum("file_size").alias("mtime"))


def scan_plan(found: DataFrame, cached: DataFrame) -> DataFrame:
    """Each folder and whether an incremental scan reads it: it does unless time and number of files are those cached."""
    known = cached.select("folder", F.col("file_count").alias("c"), F.col("mtime").alias("t"))
    same = F.coalesce((F.col("file_count") == F.col("c")) & (F.col("mtime") == F.col("t")), F.lit(False))
    return found.join(known, "folder", "left").select("folder", "file_count", (~same).alias("scan"))
