"""Folders of audio files as tables, and calibrations as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.files import parent

#: Endings of the files that are listed.
AUDIO = ("mp3", "m4a", "mp4", "aac", "flac", "ogg", "opus", "wav", "aif", "aiff", "wma")


def audio_files(spark: SparkSession, root: str) -> DataFrame:
    """normalized_path (below the root), file_size and modified_ms of the audio files below a folder; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    own = listed.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*AUDIO))
    below = F.element_at(F.split("path", F.concat(F.lit("\\Q"), F.lit(root.rstrip("/").removeprefix("file://")), F.lit("/\\E"))), -1)
    return own.select(below.alias("normalized_path"), F.col("length").alias("file_size"), F.unix_millis("modificationTime").alias("modified_ms"))


def folders_of(files: DataFrame) -> DataFrame:
    """folder, file_count and the latest modified_ms of each folder that holds audio files."""
    return files.groupBy(parent(F.col("normalized_path")).alias("folder")).agg(F.count("*").alias("file_count"), F.max("modified_ms").alias("mtime"))


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """The files that are new or whose modified_ms is not the known one: those whose tags a scan reads."""
    was = known.select("normalized_path", F.col("modified_ms").alias("was"))
    return files.join(was, "normalized_path", "left").where(F.col("was").isNull() | (F.col("was") != F.col("modified_ms"))).select("normalized_path", "file_size", "modified_ms", F.col("was").isNull().alias("is_new"))


def write_calibrations(states: DataFrame, path: str) -> None:
    """All calibrations as JSON lines, a folder a head."""
    states.write.mode("overwrite").partitionBy("head_name").json(path)


def read_calibrations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("label string, p5 double, p95 double, n long, underflow_count long, overflow_count long, head_name string").json(path)
