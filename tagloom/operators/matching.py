"""Playlist import: texts made comparable, and tracks matched by ISRC or by title and artist."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import comparable, comparable_artist
from .likeness import common_subsequence, most_alike

#: Least scores of a candidate and of a sure match, the gap within which others count as alternatives, and how many of them.
LOW, HIGH, GAP, ALTERNATIVES = 70.0, 85.0, 5.0, 3


def match(tracks: DataFrame, library: DataFrame) -> DataFrame:
    """track_id, status (isrc, exact or not_found) and file_id: by ISRC first, else by title and artist; of several files the smallest.

    Tracks have track_id, isrc, title and artist; the library file_id, isrc,
    title and artist. Two equi-joins; the library is reduced to a file a key
    before it is joined, so that repeated titles don't multiply.
    """
    keyed = lambda df: df.withColumn("t", comparable(F.col("title"))).withColumn("a", comparable_artist(F.col("artist")))
    by_isrc = library.where("isrc is not null").groupBy("isrc").agg(F.min("file_id").alias("by_isrc"))
    by_name = keyed(library).where("t <> ''").groupBy("t", "a").agg(F.min("file_id").alias("by_name"))
    found = keyed(tracks).join(by_isrc.hint("merge"), "isrc", "left").join(by_name.hint("merge"), ["t", "a"], "left")
    status = F.when(F.col("by_isrc").isNotNull(), "isrc").when(F.col("by_name").isNotNull(), "exact").otherwise("not_found")
    return found.select("track_id", status.alias("status"), F.coalesce("by_isrc", "by_name").alias("file_id"))


def moves(removed: DataFrame, new: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """file_id, old_path and new_path of files that reappear elsewhere: same fingerprint, durations at most `tolerance` apart (unknown ones fit), each file once.

    Removed files have file_id, path, fingerprint and duration; new ones path,
    fingerprint and duration. New files choose in the order of their paths, the
    removed file of smallest file_id first. Pairs form within a fingerprint
    only, and where all its durations are known, between gaps of its durations
    that are wider than `tolerance`, so that a common fingerprint is not held
    whole; rows without one are left out.
    """
    fits = lambda a, b: pd.isna(a) or pd.isna(b) or abs(a - b) <= tolerance

    def choose(gone: pd.DataFrame, come: pd.DataFrame) -> pd.DataFrame:
        left, out = list(gone.sort_values("file_id")[["file_id", "path", "duration"]].itertuples(index=False)), []
        for path, duration in come.sort_values("path")[["path", "duration"]].itertuples(index=False):
            at = next((i for i, g in enumerate(left) if fits(g.duration, duration)), None)
            if at is not None:
                g = left.pop(at)
                out.append((g.file_id, g.path, path))
        return pd.DataFrame(out, columns=["file_id", "old_path", "new_path"])

    some = [df.where("fingerprint is not null") for df in (removed, new)]
    every = some[0].select("fingerprint", "duration").union(some[1].select("fingerprint", "duration")).distinct()
    w = Window.partitionBy("fingerprint").orderBy("duration")
    unknown = F.max(F.col("duration").isNull().cast("int")).over(Window.partitionBy("fingerprint"))
    gap = (F.coalesce(F.col("duration") - F.lag("duration").over(w) > tolerance, F.lit(False)) & (unknown == 0)).cast("int")
    pieces = every.withColumn("gap", gap).withColumn("piece", F.sum("gap").over(w)).select("fingerprint", F.col("duration").alias("of"), "piece")

    # both sides of each join grow with the library: merged, as a broadcast of either would be held by the driver whole
    def cut(df: DataFrame, side: str) -> DataFrame:
        met = df.join(pieces.withColumnRenamed("fingerprint", "print").hint("merge"), (F.col("fingerprint") == F.col("print")) & F.col("duration").eqNullSafe(F.col("of")))
        # names and columns of this side alone, as both may come from one table
        own = [F.col(c).alias(c) for c in ("file_id", "path", "duration") if c in df.columns]
        return met.select(F.col("fingerprint").alias(f"{side}_print"), F.col("piece").alias(f"{side}_piece"), *own)

    old, new = cut(some[0], "old"), cut(some[1], "new")
    key = lambda side: [f"{side}_print", f"{side}_piece"]
    # one file on either side is no choice, and needs no group
    lone = lambda df, side: df.groupBy(*key(side)).agg(*(F.first(c).alias(f"{side}_{c}") for c in ("file_id", "path", "duration") if c in df.columns), F.count("*").alias(f"{side}_n"))
    met = lone(old, "old").join(lone(new, "new").hint("merge"), (F.col("old_print") == F.col("new_print")) & (F.col("old_piece") == F.col("new_piece")))
    apart = F.nanvl(F.abs(F.col("old_duration") - F.col("new_duration")).cast("double"), F.lit(0.0))
    near = F.coalesce(apart <= tolerance, F.lit(True))
    sure = met.where((F.col("old_n") == 1) & (F.col("new_n") == 1) & near).select(F.col("old_file_id").alias("file_id"), "old_path", "new_path")
    several = met.where((F.col("old_n") > 1) | (F.col("new_n") > 1))
    open_ = [df.join(several.select(*key(side)).hint("merge"), key(side), "left_semi").groupBy(*key(side)) for df, side in ((old, "old"), (new, "new"))]
    chosen = open_[0].cogroup(open_[1]).applyInPandas(choose, "file_id long, old_path string, new_path string")
    return sure.union(chosen)


def collisions(removed: DataFrame, new: DataFrame) -> DataFrame:
    """Fingerprints that several removed or several new files have, with their numbers: where moves are a choice."""
    count = lambda df, c: df.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias(c))
    return count(removed, "n_removed").join(count(new, "n_new").hint("merge"), "fingerprint").where("n_removed > 1 or n_new > 1")


def latest(tiers: DataFrame, key: str, order: list) -> DataFrame:
    """One row a key, the first in this order."""
    return tiers.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_nth = 1").drop("_nth")


def token_sort_ratio(a: str, b: str) -> float:
    """How alike two texts are whose words are sorted, 0 to 100: twice the common subsequence by both lengths. Two empty texts are alike."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def fuzzy(tracks: DataFrame, library: DataFrame) -> DataFrame:
    """track_id, status (fuzzy, ambiguous or not_found), confidence, file_id and alternatives (comma-joined) by likeness of title (0.7) and artist (0.3).

    At HIGH or more a match is sure unless another is within GAP, from LOW on
    it is ambiguous. Ties go to the smaller file_id. All pairs that may be
    among the best are compared, and no others; see `likeness`.
    """
    keyed = lambda d: d.withColumn("t", comparable(F.col("title"))).withColumn("a", comparable_artist(F.col("artist"))).withColumn("text", F.md5(F.concat_ws("\n", "t", "a")))
    # equal texts are compared once, however many tracks and files have them; of a text's files only the first can come out
    own, lib = keyed(tracks).select("track_id", "text", "t", "a"), keyed(library).select("file_id", "text", "t", "a")
    first = lib.withColumn("nth", F.row_number().over(Window.partitionBy("text").orderBy("file_id"))).where(F.col("nth") <= 1 + ALTERNATIVES).select("file_id", F.col("text").alias("of"))
    asked = own.groupBy("text").agg(F.first("t").alias("t"), F.first("a").alias("a"))
    held = lib.groupBy(F.col("text").alias("of")).agg(F.first("t").alias("t"), F.first("a").alias("a"), F.min("file_id").alias("first"))
    scored = most_alike(asked, held, LOW, 1 + ALTERNATIVES).join(first, "of").select("text", "file_id", "score")
    w = Window.partitionBy("text").orderBy(F.col("score").desc(), "file_id")
    best = scored.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= 1 + ALTERNATIVES)
    at = lambda n, c: F.max(F.when(F.col("nth") == n, F.col(c)))
    others = F.array_sort(F.collect_list(F.when(F.col("nth") > 1, F.struct("nth", "file_id"))))
    flat = best.groupBy("text").agg(at(1, "score").alias("score"), at(1, "file_id").alias("file_id"), at(2, "score").alias("second"), others.alias("others"))
    near = F.coalesce(F.col("score") - F.col("second") < GAP, F.lit(False))
    joined = F.when(near, F.array_join(F.transform("others", lambda x: x["file_id"].cast("string")), ",")).otherwise("")
    status = F.when(F.col("score").isNull(), "not_found").when((F.col("score") >= HIGH) & ~near, "fuzzy").otherwise("ambiguous")
    return own.select("track_id", "text").join(flat, "text", "left").select("track_id", status.alias("status"), F.coalesce(F.round(F.col("score") / 100, 6), F.lit(0.0)).alias("confidence"), "file_id", F.coalesce(joined, F.lit("")).alias("alternatives"))


def match_all(tracks: DataFrame, library: DataFrame) -> DataFrame:
    """track_id, status, confidence and file_id: by ISRC, else by equal title and artist, else by likeness, which only the rest goes through."""
    first = match(tracks, library)
    sure = first.where("status <> 'not_found'").select("track_id", "status", F.lit(1.0).alias("confidence"), "file_id")
    rest = tracks.join(sure.select("track_id"), "track_id", "left_anti")
    return sure.union(fuzzy(rest, library).select("track_id", "status", "confidence", "file_id"))


def status_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("status").agg(F.count("*").alias("n_tracks"))
