"""A player's inventory against what is stored: one log of what is inserted, updated and deleted, and the tables after it.

The log names the old and the new values of each change, so that it can be read,
counted and applied; applied twice it changes nothing more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Paths that are looked at to find out what the player puts before them.
SAMPLE = 50
LOG = "entity string, action string, nd_id string, user_id long, old_file_id long, new_file_id long, old_count long, new_count long, old_last long, new_last long"


def detect_prefix(songs: DataFrame, files: DataFrame) -> str | None:
    """What stands before a file's normalized_path in the player's paths (nd_path): by the first of a sample of paths that ends with a known path; None if none does.

    The sample is the SAMPLE smallest paths; each is looked up with all that may
    stand before it, longest path first.
    """
    some = songs.where("nd_path IS NOT NULL").select("nd_path").distinct().orderBy("nd_path").limit(SAMPLE)
    parts = F.split("nd_path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    each = some.select("nd_path", F.explode(F.array_distinct(F.concat(F.array("nd_path"), tails))).alias("normalized_path")).where("normalized_path <> ''")
    found = each.join(files.select("normalized_path"), "normalized_path", "left_semi")
    one = found.orderBy("nd_path", F.length("normalized_path").desc()).limit(1).first()
    return one.nd_path[: len(one.nd_path) - len(one.normalized_path)] if one else None


def target(songs: DataFrame, files: DataFrame, prefix: str = "") -> DataFrame:
    """nd_id, new_file_id (null if no file has the path), new_count and new_last (null without plays): what a sync is to lead to. A repeated nd_id counts once, with its largest values; of files with one path the smallest counts."""
    path = F.when(F.col("nd_path").startswith(prefix), F.expr(f"substring(nd_path, {len(prefix) + 1})")).otherwise(F.col("nd_path"))
    by_path = files.groupBy(F.col("normalized_path").alias("path")).agg(F.min("file_id").alias("new_file_id"))
    own = songs.where("nd_id IS NOT NULL").withColumn("path", path).join(by_path, "path", "left")
    some = F.col("play_count") > 0
    return own.groupBy("nd_id").agg(F.min("new_file_id").alias("new_file_id"), F.max(F.when(some, F.col("play_count"))).alias("new_count"), F.max(F.when(some, F.col("last_played_ms"))).alias("new_last"))


def changes(wanted: DataFrame, user_id: int, tracks: DataFrame, links: DataFrame, plays: DataFrame) -> DataFrame:
    """The log (LOG) that leads from tracks (nd_id), links (nd_id, file_id) and plays (user_id, nd_id, playcount, last_played) to `wanted`.

    Tracks that the player does not have any more go, with their links and all
    users' plays. A link follows the file that the path names now; where none
    does, it stays. The user's plays become those of the player; other users'
    plays stay as they are on tracks that stay. One full join by nd_id; only
    other users' plays of deleted tracks are looked up besides.
    """
    held = tracks.select("nd_id").distinct().withColumn("held", F.lit(True))
    linked = links.groupBy("nd_id").agg(F.max("file_id").alias("old_file_id"))
    own = plays.where(F.col("user_id") == user_id).groupBy("nd_id").agg(F.max("playcount").alias("old_count"), F.max("last_played").alias("old_last"))
    now = held.join(linked, "nd_id", "full").join(own, "nd_id", "full")
    both = now.join(wanted.withColumn("wanted", F.lit(True)), "nd_id", "full").withColumns({"held": F.coalesce("held", F.lit(False)), "wanted": F.coalesce("wanted", F.lit(False))})
    old_f, new_f, old_n, new_n = (F.col(c) for c in ("old_file_id", "new_file_id", "old_count", "new_count"))
    same = (old_n == new_n) & F.col("old_last").eqNullSafe(F.col("new_last"))
    track = F.when(F.col("wanted") & ~F.col("held"), "insert").when(~F.col("wanted") & F.col("held"), "delete")
    link = F.when(~F.col("wanted") & old_f.isNotNull(), "delete").when(new_f.isNotNull() & old_f.isNull(), "insert").when(new_f != old_f, "update")
    play = F.when(new_n.isNotNull() & old_n.isNull(), "insert").when(new_n.isNull() & old_n.isNotNull(), "delete").when(~same, "update")

    def entry(entity: str, action: Column, user: Column, *shown: str) -> Column:
        values = [F.when(F.lit(c in shown), F.col(c).cast("long")).alias(c) for c in ("old_file_id", "new_file_id", "old_count", "new_count", "old_last", "new_last")]
        return F.struct(F.lit(entity).alias("entity"), action.alias("action"), user.cast("long").alias("user_id"), *values)

    nobody = F.lit(None)
    entries = F.array(
        entry("track", track, nobody),
        entry("link", link, nobody, "old_file_id", "new_file_id"),
        entry("play", play, F.lit(user_id), "old_count", "new_count", "old_last", "new_last"),
    )
    log = both.select("nd_id", F.inline(entries)).where("action IS NOT NULL")
    # a deleted link names no new file
    gone = both.where("NOT wanted AND held").select("nd_id")
    others = plays.where(F.col("user_id") != user_id).join(gone, "nd_id", "left_semi")
    null = F.lit(None).cast("long")
    rest = others.select(F.lit("play").alias("entity"), F.lit("delete").alias("action"), "nd_id", F.col("user_id").cast("long"), null, null, F.col("playcount").cast("long"), null, F.col("last_played").cast("long"), null)
    columns = [c.split()[0] for c in LOG.split(", ")]
    return log.select(*columns).union(rest.toDF(*columns))


def applied(log: DataFrame, tracks: DataFrame, links: DataFrame, plays: DataFrame) -> dict[str, DataFrame]:
    """The tables tracks, links and plays after a log."""
    of = lambda e: log.where(F.col("entity") == e)
    t, li, p = of("track"), of("link"), of("play")
    after = tracks.select("nd_id").join(t.where("action = 'delete'").select("nd_id"), "nd_id", "left_anti").union(t.where("action = 'insert'").select("nd_id")).distinct()
    linked = links.select("nd_id", "file_id").join(li.select("nd_id"), "nd_id", "left_anti").union(li.where("action <> 'delete'").select("nd_id", "new_file_id"))
    played = plays.select("user_id", "nd_id", "playcount", "last_played").join(p.select("user_id", "nd_id"), ["user_id", "nd_id"], "left_anti").union(p.where("action <> 'delete'").select("user_id", "nd_id", "new_count", "new_last"))
    return {"tracks": after, "links": linked, "plays": played}


def summary(log: DataFrame) -> DataFrame:
    """entity, action and how many changes of each kind there are."""
    return log.groupBy("entity", "action").agg(F.count("*").alias("n"))
