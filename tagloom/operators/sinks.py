"""What is handed on as text: playlists, configuration, calibration bundles. Lines and documents are made as columns; writers write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import aliases, field_name, short_name

#: What file names don't take.
UNSAFE = r'[<>:"/\\|?*\x00-\x1f]'


def m3u_lines(files: DataFrame, order: DataFrame, root: str = "") -> DataFrame:
    """nth and the two lines of each entry, in the requested order (file_id, nth): unknown files are left out, an unknown length is -1, a missing artist Unknown Artist and a missing title the file's name."""
    name = F.element_at(F.split("normalized_path", "/"), -1)
    info = F.concat(F.lit("#EXTINF:"), F.coalesce(F.floor("duration_seconds"), F.lit(-1)).cast("string"), F.lit(","), F.coalesce("artist", F.lit("Unknown Artist")), F.lit(" - "), F.coalesce("title", name))
    return order.join(files, "file_id").select("nth", info.alias("info"), F.concat(F.lit(root), "normalized_path").alias("path"))


def m3u(lines: DataFrame, name: str) -> DataFrame:
    """One row: the whole playlist as text. A playlist is one document; lists of a library's size are written by lines."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "info", "path"))), lambda x: F.concat(x["info"], F.lit("\n"), x["path"])), "\n")
    return lines.agg(F.concat(F.lit(f"#EXTM3U\n#PLAYLIST:{name}\n"), body).alias("text"))


def safe_name(name: Column) -> Column:
    """A playlist's name as a file's: unsafe characters become underscores; without any it is playlist."""
    clean = F.trim(F.regexp_replace(name, UNSAFE, "_"))
    return F.concat(F.when(F.coalesce(clean, F.lit("")) == "", "playlist").otherwise(clean), F.lit(".m3u"))


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines of a playlist in order, as text files of a folder."""
    lines.orderBy("nth").select(F.concat("info", F.lit("\n"), "path").alias("value")).write.mode("overwrite").text(path)


def config_fields(stats: DataFrame) -> DataFrame:
    """Per rel (with `numeric`) what a player's configuration says of it: field, short name, kind and the spellings to look for."""
    short = short_name(F.col("rel"), F.col("numeric"))
    return stats.select("rel", short.alias("short_name"), field_name(short).alias("field"), F.when(F.col("numeric"), "float").otherwise("string").alias("kind"), F.array_join(aliases(F.col("rel")), ",").alias("aliases"))


def toml(fields: DataFrame) -> DataFrame:
    """Each field as a table of a TOML document."""
    quoted = F.array_join(F.transform(F.split("aliases", ","), lambda a: F.concat(F.lit('"'), a, F.lit('"'))), ", ")
    return fields.select("field", F.concat(F.lit("[Tags."), "field", F.lit("]\nAliases = ["), quoted, F.lit("]\nType = \""), "kind", F.lit('"')).alias("text"))


def bundle(states: DataFrame) -> DataFrame:
    """One row a head: its calibrations as a JSON object of labels, in their order."""
    one = F.struct("label", F.struct("p5", "p95", F.lit("minmax").alias("method")).alias("c"))
    return states.groupBy("head_name").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(one)))).alias("json"))


def from_bundle(bundles: DataFrame) -> DataFrame:
    """The calibrations of bundles (head_name, json); what is not JSON of this form gives none."""
    parsed = F.from_json("json", "map<string,struct<p5:double,p95:double,method:string>>")
    return bundles.select("head_name", F.explode(parsed).alias("label", "c")).where("c.p5 is not null and c.p95 is not null").select("head_name", "label", "c.p5", "c.p95")


def imported(known: DataFrame, new: DataFrame, overwrite: bool) -> DataFrame:
    """Each calibration of an import (head_name, label, p5, p95) with what happens to it: added, replaced or skipped."""
    there = known.select("head_name", "label", F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "added").when(F.lit(overwrite), "replaced").otherwise("skipped")
    return new.join(there, ["head_name", "label"], "left").select("head_name", "label", "p5", "p95", status.alias("status"))
