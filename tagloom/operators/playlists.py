"""Playlists and calibrations as documents: lines in order, of any number of documents at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sinks import UNSAFE

#: What of a conversion is sure enough to be listed.
MATCHED = ("isrc", "exact", "fuzzy")


def file_name(name: Column) -> Column:
    """A playlist's name as a file's, without its ending: unsafe characters become underscores, dots and spaces at the ends go; without any it is playlist."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), UNSAFE, "_"), r"^[. ]+|[. ]+$", "")
    return F.when(clean == "", "playlist").otherwise(clean)


def documents_of(playlists: DataFrame) -> DataFrame:
    """playlist_id and document of each playlist (playlist_id, name). Names that become one file name are told apart by a number, in the order of playlist_id."""
    same = Window.partitionBy(file_name(F.col("name"))).orderBy("playlist_id")
    nth = F.row_number().over(same)
    number = F.when(nth > 1, F.concat(F.lit(" ("), nth.cast("string"), F.lit(")"))).otherwise("")
    return playlists.select("playlist_id", F.concat(file_name(F.col("name")), number, F.lit(".m3u")).alias("document"))


def m3u_documents(playlists: DataFrame, entries: DataFrame) -> DataFrame:
    """document, nth and line of the M3U files of `playlists` (playlist_id, name, source_url, platform) with their `entries`.

    Entries have playlist_id, nth, status, path, duration_ms, artist and title;
    only those that are matched (MATCHED) and have a path are listed, ambiguous
    ones need a look first. An unknown length is -1. A playlist without such
    entries has its header. Lines that say where a list comes from are left out
    where that is unknown.
    """
    named = playlists.join(documents_of(playlists), "playlist_id")
    said = F.array_compact(F.array(
        F.lit("#EXTM3U"), F.concat(F.lit("#PLAYLIST:"), F.coalesce("name", F.lit(""))),
        F.concat(F.lit("# Source: "), "source_url"), F.concat(F.lit("# Converted from "), "platform"),
        F.when(F.col("source_url").isNotNull() | F.col("platform").isNotNull(), F.lit("")),
    ))
    at = lambda part, nth, k: F.struct(F.lit(part).alias("part"), nth.cast("long").alias("nth"), k.alias("line"))
    head = named.select("document", F.posexplode(said).alias("i", "line")).select("document", at(0, F.col("i"), F.lit(0)).alias("nth"), "line")
    seconds = F.coalesce(F.floor(F.when(F.col("duration_ms") > 0, F.col("duration_ms")) / 1000), F.lit(-1)).cast("string")
    text = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[\r\n]", " ")
    info = F.concat(F.lit("#EXTINF:"), seconds, F.lit(","), text("artist"), F.lit(" - "), text("title"))
    listed = entries.where(F.col("status").isin(*MATCHED) & F.col("path").isNotNull()).join(named.select("playlist_id", "document"), "playlist_id")
    body = listed.select("document", F.col("nth").alias("at"), F.posexplode(F.array(info, F.col("path"))).alias("i", "line")).select("document", at(1, F.col("at"), F.col("i")).alias("nth"), "line")
    return head.union(body)


def sidecars(states: DataFrame, heads: DataFrame, version: int, library_size: int, min_samples: int = 1000) -> DataFrame:
    """document, nth and line of a JSON file a head that has calibrations, named after its model.

    `states` has head_name, label, p5 and p95; `heads` head_name, model (its path
    below the models' folder, with an ending), head_type and backbone. Heads are
    few, and have a few hundred labels.
    """
    model = F.regexp_replace("model", r"\.[^./]*$", "")
    own = states.join(heads, "head_name").groupBy("model", "head_type", "backbone").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.struct("p5", "p95"))))).alias("labels"))
    base = F.element_at(F.split(model, "/"), -1)
    content = F.to_json(F.struct(
        F.lit(version).alias("calibration_version"), F.lit("minmax").alias("calibration_method"), F.lit(library_size).alias("library_size"),
        F.lit(min_samples).alias("min_samples"), base.alias("model"), "head_type", "backbone", "labels",
    ))
    return own.select(F.concat(model, F.lit(f"-calibration-v{version}.json")).alias("document"), F.lit(0).alias("nth"), content.alias("line"))
