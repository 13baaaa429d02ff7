"""File states: a table of file_id, axis and positive, one row a file and axis.

A file without a row on an axis is in neither of its two states. Functions take
and return whole tables; a transition gives the new table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The axes.
AXES = ("tagged", "too_short", "calibrated", "tags_written", "tags_current", "scanned", "vectors_extracted", "errored")


def in_state(states: DataFrame, axis: str, positive: bool = True) -> DataFrame:
    """file_id of those in one state."""
    return states.where((F.col("axis") == axis) & (F.col("positive") == positive)).select("file_id")


def initialised(states: DataFrame, files: DataFrame) -> DataFrame:
    """The table with each of `files` on the negative side of every axis that it has no row for."""
    axes = F.explode(F.array(*map(F.lit, AXES))).alias("axis")
    new = files.select("file_id", axes).distinct().join(states, ["file_id", "axis"], "left_anti")
    return states.select("file_id", "axis", "positive").union(new.select("file_id", "axis", F.lit(False)))


def transitioned(states: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after `changes` (file_id, axis, positive, at): of several changes of an axis the latest holds, of two at once the positive."""
    w = Window.partitionBy("file_id", "axis").orderBy(F.col("at").desc(), F.col("positive").desc())
    last = changes.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("file_id", "axis", "positive")
    return states.select("file_id", "axis", "positive").join(last, ["file_id", "axis"], "left_anti").union(last)


def moved(states: DataFrame, axis: str, to: bool, files: DataFrame | None = None) -> DataFrame:
    """The table with one axis of all rows, or of those of `files`, on one side; files without a row stay without."""
    on_axis = F.col("axis") == axis
    if files is None:
        return states.select("file_id", "axis", F.when(on_axis, F.lit(to)).otherwise(F.col("positive")).alias("positive"))
    chosen = files.select("file_id").distinct().withColumn("chosen", F.lit(True))
    hit = on_axis & F.col("chosen").isNotNull()
    return states.join(chosen, "file_id", "left").select("file_id", "axis", F.when(hit, F.lit(to)).otherwise(F.col("positive")).alias("positive"))


def cleared(states: DataFrame, axis: str, files: DataFrame) -> DataFrame:
    """The table with `files` on the negative side of an axis, whether or not they had a row."""
    ids = files.select("file_id").distinct()
    rest = states.select("file_id", "axis", "positive").join(ids.withColumn("axis", F.lit(axis)), ["file_id", "axis"], "left_anti")
    return rest.union(ids.select("file_id", F.lit(axis), F.lit(False)))


def waiting(files: DataFrame, states: DataFrame, claims: DataFrame | None = None, library: int | None = None) -> DataFrame:
    """The files to tag next: not tagged, not too short, not errored, and not claimed (any claim counts)."""
    if library is not None:
        files = files.where(F.col("library_id") == library)
    out = files.join(in_state(states, "tagged", False), "file_id", "left_semi")
    for axis in ("too_short", "errored"):
        out = out.join(in_state(states, axis), "file_id", "left_anti")
    return out if claims is None else out.join(claims.select("file_id"), "file_id", "left_anti")


def both_states(states: DataFrame, one: tuple[str, bool], two: tuple[str, bool]) -> DataFrame:
    """file_id of those in two states: one pass over the table, no join."""
    hit = lambda s: F.max(F.when((F.col("axis") == s[0]) & (F.col("positive") == s[1]), 1).otherwise(0))
    some = states.where(F.col("axis").isin(one[0], two[0]))
    return some.groupBy("file_id").agg(hit(one).alias("a"), hit(two).alias("b")).where("a = 1 AND b = 1").select("file_id")


def counts(files: DataFrame, states: DataFrame, axis: str) -> DataFrame:
    """Per library how many files are on the positive and on the negative side of an axis; a library without any has zeros."""
    own = states.where(F.col("axis") == axis)
    joined = files.select("library_id", "file_id").join(own, "file_id", "left")
    return joined.groupBy("library_id").agg(F.count_if(F.col("positive")).alias("n_positive"), F.count_if(~F.col("positive")).alias("n_negative"))


def all_counts(states: DataFrame) -> DataFrame:
    """Per axis how many files are on either side."""
    return states.groupBy("axis").agg(F.count_if(F.col("positive")).alias("n_positive"), F.count_if(~F.col("positive")).alias("n_negative"))


def outdated(files: DataFrame, states: DataFrame, libraries: DataFrame) -> DataFrame:
    """Per library that is written to (file_write_mode not none) the files whose tags are stale or not written, where there are any."""
    some = states.where(F.col("axis").isin("tags_current", "tags_written") & ~F.col("positive")).select("file_id").distinct()
    writable = libraries.where("file_write_mode <> 'none'").select("library_id", "name")
    return files.join(some, "file_id", "left_semi").groupBy("library_id").agg(F.count("*").alias("n_outdated")).join(writable, "library_id")


def head_coverage(files: DataFrame, tags: DataFrame, states: DataFrame, heads: list[tuple[str, list[str], str]]) -> DataFrame:
    """Per tagged file how many of the expected heads have a tag, and which have none (sorted, comma-joined).

    A head has a key, labels and a model key; a tag of rel `nom:<label>_...`
    counts for it if the label is one of the head's and the rest of the rel
    holds the model key. Each expected head is one flag of one aggregation.
    """
    rest = F.substring("rel", 5, 1 << 20)
    label = F.substring_index(rest, "_", 1)
    own = tags.where(F.col("rel").startswith("nom:"))
    flags = [F.max(F.when(label.isin(labels) & rest.contains(model), 1).otherwise(0)).alias(f"h{i}") for i, (_, labels, model) in enumerate(heads)]
    has = own.groupBy("file_id").agg(*flags)
    tagged = files.join(in_state(states, "tagged"), "file_id", "left_semi").select("file_id", "library_id")
    found = tagged.join(has, "file_id", "left")
    lacks = [F.when(F.coalesce(f"h{i}", F.lit(0)) == 0, F.lit(key)) for i, (key, _, _) in enumerate(heads)]
    missing = F.array_sort(F.array_compact(F.array(*lacks)))
    out = found.select("file_id", "library_id", missing.alias("missing"))
    return out.select("file_id", "library_id", (F.lit(len(heads)) - F.size("missing")).cast("long").alias("matched_count"), F.size("missing").cast("long").alias("missing_count"), F.array_join("missing", ",").alias("missing_heads"))


def missing_histogram(coverage: DataFrame) -> DataFrame:
    """How many tagged files lack each head."""
    each = coverage.where("missing_count > 0").select(F.explode(F.split("missing_heads", ",")).alias("head"))
    return each.groupBy("head").agg(F.count("*").alias("n_files"))


def healed_short(files: DataFrame, states: DataFrame, min_seconds: float) -> DataFrame:
    """The changes (file_id, axis, positive) that make `too_short` say what durations say; unknown durations change nothing."""
    short = files.where("duration_seconds is not null").select("file_id", (F.col("duration_seconds") < min_seconds).alias("short"))
    now = states.where("axis = 'too_short'").select("file_id", "positive")
    return short.join(now, "file_id").where(F.col("short") != F.col("positive")).select("file_id", F.lit("too_short").alias("axis"), F.col("short").alias("positive"))
