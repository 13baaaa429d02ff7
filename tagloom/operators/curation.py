"""Tag curation: the dictionary of tags, and edits that give the new table and the counts of what they did.

A tag table has file_id, rel, value_str and value_num; a tag is a rel with one
value, of either kind. Rels of the namespace RESERVED are read-only to curators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the namespace that only models write to.
RESERVED = "nom:"
VALUE = ["rel", "value_str", "value_num"]


def tag_id() -> Column:
    """An id from rel, kind and value, so that the same tag has the same id in every table."""
    text = F.when(F.col("value_str").isNotNull(), F.concat(F.lit("s|"), "value_str")).otherwise(F.concat(F.lit("n|"), F.col("value_num").cast("string")))
    return F.md5(F.concat("rel", F.lit("|"), text))


def dictionary(tags: DataFrame) -> DataFrame:
    """tag_id, rel, value_str and value_num of each tag."""
    return tags.select(*VALUE).distinct().select(tag_id().alias("tag_id"), *VALUE)


def resolved(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Each pair (rel, value_str) with its tag_id, null where there is none."""
    own = known.where("value_str is not null").select("rel", "value_str", "tag_id")
    return pairs.join(own, ["rel", "value_str"], "left")


def writable(rel: str) -> str:
    if rel.startswith(RESERVED):
        raise ValueError(f"{rel} is read-only")
    return rel


def _source(rel: str, values: list[str]) -> Column:
    return (F.col("rel") == rel) & F.col("value_str").isin(values)


def relinked(tags: DataFrame, rel: str, sources: list[str], target: str, files: DataFrame | None = None) -> DataFrame:
    """The table with the tags `sources` of a rel turned into `target`, for all files or the listed ones; a file that has both keeps one edge."""
    writable(rel)
    hit = _source(rel, sources)
    if files is not None:
        tags = tags.join(files.select("file_id").distinct().withColumn("listed", F.lit(True)), "file_id", "left")
        hit = hit & F.col("listed").isNotNull()
    return tags.select("file_id", "rel", F.when(hit, F.lit(target)).otherwise(F.col("value_str")).alias("value_str"), "value_num").distinct()


def relink_counts(tags: DataFrame, rel: str, sources: list[str], target: str, files: DataFrame | None = None) -> DataFrame:
    """One row: edges moved, edges skipped (the file has the target already, or gets it from an earlier source), and how many sources are left without a file.

    One aggregation by file and one over its few counts; edges are not joined with themselves.
    """
    own = tags.where(_source(rel, [*sources, target])).select("file_id", "value_str").distinct()
    listed = own.withColumn("listed", F.lit(True)) if files is None else own.join(files.select("file_id").distinct().withColumn("listed", F.lit(True)), "file_id", "left")
    from_source = F.col("value_str").isin(sources) & F.col("listed").isNotNull()
    per_file = listed.groupBy("file_id").agg(F.count_if(from_source).alias("n"), F.max((F.col("value_str") == target).cast("int")).alias("has"))
    left = [F.max(((F.col("value_str") == s) & F.col("listed").isNull()).cast("int")).alias(f"left{i}") for i, s in enumerate(sources)]
    there = [F.max((F.col("value_str") == s).cast("int")).alias(f"was{i}") for i, s in enumerate(sources)]
    gone = sum((F.coalesce(F.col(f"was{i}"), F.lit(0)) * (1 - F.coalesce(F.col(f"left{i}"), F.lit(0))) for i in range(len(sources))), F.lit(0))
    moved = F.count_if((F.col("n") > 0) & (F.col("has") == 0))
    sums = per_file.agg(moved.alias("moved"), (F.coalesce(F.sum("n"), F.lit(0)) - moved).alias("skipped"))
    ends = listed.agg(*left, *there).select(gone.cast("long").alias("sources_removed"))
    # two one-row tables
    return sums.crossJoin(ends)


def touched(tags: DataFrame, rel: str, values: list[str]) -> DataFrame:
    """file_id of the files that have one of these tags: those to write anew after an edit."""
    return tags.where(_source(rel, values)).select("file_id").distinct()


def added(tags: DataFrame, new: DataFrame) -> DataFrame:
    """The table with further tags (file_id, rel, value_str, value_num); what is there already is not added."""
    cols = ["file_id", *VALUE]
    return tags.select(*cols).union(new.select(*cols)).distinct()


def replaced(tags: DataFrame, new: DataFrame) -> DataFrame:
    """The table with all tags of each (file_id, rel) in `new` replaced by those there: the batch form of setting a file's tags."""
    cols = ["file_id", *VALUE]
    return tags.join(new.select("file_id", "rel").distinct(), ["file_id", "rel"], "left_anti").select(*cols).union(new.select(*cols).distinct())


def without_files(tags: DataFrame, files: DataFrame) -> DataFrame:
    """The table without any tag of these files."""
    return tags.join(files.select("file_id"), "file_id", "left_anti")


def orphans(known: DataFrame, tags: DataFrame, outputs: DataFrame) -> DataFrame:
    """The tags of a dictionary that no file has and no model output (tag_id) refers to."""
    used = tags.select(tag_id().alias("tag_id")).distinct()
    return known.join(used, "tag_id", "left_anti").join(outputs.select("tag_id"), "tag_id", "left_anti")


def scored_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (tag_id, output_id, score, created_at, updated_at) after `new` ones (tag_id, output_id, score, at): those that exist keep created_at."""
    was = edges.select("tag_id", "output_id", F.col("score").alias("old"), "created_at", "updated_at")
    both = was.join(new, ["tag_id", "output_id"], "full")
    return both.select("tag_id", "output_id", F.coalesce("score", "old").alias("score"), F.coalesce("created_at", "at").alias("created_at"), F.coalesce("at", "updated_at").alias("updated_at"))


def for_mode(tags: DataFrame, mode: str, calibrated: bool = True) -> DataFrame:
    """The tags of the namespace that are written to files: none, minimal (moods only) or full; without a calibration no moods."""
    if mode not in ("none", "minimal", "full"):
        raise ValueError(f"unknown mode {mode}")
    own = tags.where(F.col("rel").startswith(RESERVED))
    mood = F.col("rel").startswith(f"{RESERVED}mood-")
    if mode == "none":
        return own.limit(0)
    if mode == "minimal":
        own = own.where(mood)
    return own if calibrated else own.where(~mood)


def numbers(tags: DataFrame, version_rel: str) -> DataFrame:
    """The namespace's numeric tags but for moods and the version's own."""
    rel = F.col("rel")
    return tags.where(F.col("value_num").isNotNull() & rel.startswith(RESERVED) & ~rel.startswith(f"{RESERVED}mood-") & (rel != version_rel))
