"""Stored tables after inserts, updates and deletes: each function gives the new table, which a job writes to a new path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_folder_keys(folders: DataFrame) -> DataFrame:
    """With `key`, the hash of library and folder, by which folders are told apart."""
    return folders.withColumn("key", F.md5(F.concat_ws("/", F.col("library_id").cast("string"), "folder")))


def segment_key(file_id, head, version):
    """The hash of file, head and version of the tagger."""
    return F.sha1(F.concat_ws("|", file_id.cast("string"), head, version))


def plays_after(plays: DataFrame, new: DataFrame) -> DataFrame:
    """Plays (user_id, nd_id, playcount, last_played) after new ones: a user's track has one row, that of the larger count; the later play counts as the last."""
    cols = ["user_id", "nd_id", "playcount", "last_played"]
    both = plays.select(*cols).union(new.select(*cols))
    return both.groupBy("user_id", "nd_id").agg(F.max("playcount").alias("playcount"), F.max("last_played").alias("last_played"))


def plays_rebuilt(plays: DataFrame, new: DataFrame) -> DataFrame:
    """Plays with all rows of the users in `new` replaced by these, one a track."""
    cols = ["user_id", "nd_id", "playcount", "last_played"]
    rest = plays.select(*cols).join(new.select("user_id").distinct(), "user_id", "left_anti")
    return rest.select(*cols).union(new.groupBy("user_id", "nd_id").agg(F.max("playcount"), F.max("last_played")))


def inserted(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The table with the rows of `new` whose key it lacks, one a key."""
    return table.union(new.dropDuplicates(key).join(table.select(*key), key, "left_anti").select(*table.columns))


def moved_files(files: DataFrame, moves: DataFrame) -> DataFrame:
    """Files with the new paths of those that moved (file_id, new_path); their folder follows."""
    target = moves.select("file_id", "new_path")
    return files.join(target.hint("merge"), "file_id", "left").withColumn("normalized_path", F.coalesce("new_path", "normalized_path")).drop("new_path").select(*files.columns)


def cascade(gone: DataFrame, key: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """All dependent tables without the rows of what is gone."""
    return {name: t.join(gone.select(key).distinct(), key, "left_anti").select(*t.columns) for name, t in tables.items()}


def idle_claims(claims: DataFrame, beats: DataFrame, cutoff: int) -> DataFrame:
    """Claims of workers whose last sign of life (worker_id, at) is before the cutoff, or who gave none."""
    alive = beats.groupBy("worker_id").agg(F.max("at").alias("at")).where(F.col("at") >= cutoff)
    return claims.join(alive, "worker_id", "left_anti")


def settled(changes: DataFrame, quiet: str) -> DataFrame:
    """Per library the bursts of changes (library_id, ts) that a pause of `quiet` ends: when a scan starts, and how many changes it answers."""
    burst = F.session_window(F.col("ts"), quiet)
    return changes.groupBy("library_id", burst.alias("w")).agg(F.count("*").alias("n_changes")).select("library_id", F.col("w.end").alias("scan_at"), "n_changes")
