"""Taste weights and playlists from plays (user_id, nd_id, playcount, last_played)."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import dot, normalized

HALF_LIFE_DAYS = 30.0
MS_PER_DAY = 86_400_000.0


def taste_weights(plays: DataFrame, now: str, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """ln(1 + plays), halved for each half-life since the last play, in days and fractions of days by milliseconds; without a date, two half-lives."""
    ms = F.timestamp_diff("MILLISECOND", F.col("last_played"), F.lit(now).cast("timestamp_ntz"))
    days = F.coalesce(ms / F.lit(MS_PER_DAY), F.lit(2 * half_life))
    return plays.select("user_id", "nd_id", (F.log1p("playcount") * F.exp(-days * (math.log(2) / half_life))).alias("weight"))


def top_tracks(plays: DataFrame, n: int) -> DataFrame:
    """Each user's most played tracks; ties by the later play, then the track."""
    w = Window.partitionBy("user_id").orderBy(F.col("playcount").desc(), F.col("last_played").desc(), "nd_id")
    return plays.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("user_id", "nd_id", "playcount", "rank")


def with_files(top: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """Tracks (nd_id) with their file's title and artist, null where they have none; of several files the smallest."""
    one = links.groupBy("nd_id").agg(F.min("file_id").alias("file_id"))
    return top.join(one, "nd_id", "left").join(files.select("file_id", "title", "artist"), "file_id", "left").select(*top.columns, "file_id", "title", "artist")


def most_users(plays: DataFrame, n: int) -> DataFrame:
    """The tracks that most users play, over all users."""
    return plays.groupBy("nd_id").agg(F.count("*").alias("users"), F.sum("playcount").alias("plays")).orderBy(F.col("users").desc(), F.col("plays").desc(), "nd_id").limit(n)


def least_by_others(plays: DataFrame, user: int, n: int) -> DataFrame:
    """Tracks that the user has not played, the least played by others first."""
    own = plays.where(F.col("user_id") == user).select("nd_id")
    return plays.groupBy("nd_id").agg(F.sum("playcount").alias("plays")).join(own, "nd_id", "left_anti").orderBy("plays", "nd_id").limit(n)


def genre_shares(plays: DataFrame, tags: DataFrame) -> DataFrame:
    """Per user and genre the plays."""
    genres = tags.where("rel = 'genre'").select(F.col("file_id").alias("nd_id"), F.col("value_str").alias("genre")).distinct()
    return plays.join(genres, "nd_id").groupBy("user_id", "genre").agg(F.sum("playcount").alias("plays"))


def taste_centroids(weights: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per user the weighted mean of the played tracks' vectors, at length 1, a row a dimension: user_id, dim (from 0) and value.

    A play travels to its user once, with its track's vector in one row, and
    is taken apart there: a row a dimension would be many times as much.
    """
    own = weights.join(vectors.select(F.col("file_id").alias("nd_id"), "vector"), "nd_id").repartition("user_id")
    sums = own.select("user_id", "weight", F.posexplode("vector").alias("dim", "x")).groupBy("user_id", "dim").agg(F.sum(F.col("weight") * F.col("x").cast("double")).alias("s"))
    length = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy("user_id")))
    return sums.withColumn("length", length).select("user_id", "dim", F.when(F.col("length") > 0, F.col("s") / F.col("length")).otherwise(0.0).alias("value"))


def sync_status(plays: DataFrame, files: DataFrame) -> DataFrame:
    """Of each track of either side: matched, orphan (played, but no file) or unplayed."""
    played = plays.select(F.col("nd_id").alias("file_id")).distinct().withColumn("p", F.lit(1))
    both = files.select("file_id", F.lit(1).alias("f")).join(played, "file_id", "full")
    return both.select("file_id", F.when(F.col("f").isNull(), "orphan").when(F.col("p").isNull(), "unplayed").otherwise("matched").alias("status"))


def busiest(plays: DataFrame) -> DataFrame:
    """The plays of the user with the most tracks; of several the smallest id."""
    one = plays.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "user_id").limit(1)
    return plays.join(F.broadcast(one.select("user_id")), "user_id", "left_semi")


def profile(own: DataFrame, vectors: DataFrame, now: str, top_n: int = 200, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """One user's taste: track_count, and `q`, the weighted mean of the vectors of the user's `top_n` most played tracks, at length 1. No row without such vectors."""
    top = own.orderBy(F.col("playcount").desc(), "nd_id").limit(top_n)
    return _centroid(taste_weights(top, now, half_life).join(vectors.select(F.col("file_id").alias("nd_id"), "vector"), "nd_id"), [])


def _centroid(weighted: DataFrame, by: list[str]) -> DataFrame:
    """Of rows with weight and vector, by group, the mean at length 1 (`q`), the weight of the group and its number of tracks. Sums are of dimensions, so that no group is collected."""
    each = weighted.select(*by, "nd_id", "weight", F.posexplode("vector").alias("dim", "x"))
    sums = each.groupBy(*by, "dim").agg(F.sum(F.col("weight") * F.col("x").cast("double")).alias("s"), F.sum("weight").alias("affinity"), F.count("*").alias("track_count"))
    # a row a dimension is left
    whole = sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "s"))), lambda d: d["s"]).alias("raw"), F.max("affinity").alias("affinity"), F.max("track_count").alias("track_count"))
    size = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda t, x: t + x * x))
    some = whole.where(F.col("raw").isNotNull() & (F.size("raw") > 0)).withColumn("size", size)
    return some.select(*by, F.transform("raw", lambda x: F.when(F.col("size") > 0, x / F.col("size")).otherwise(F.lit(0.0))).alias("q"), "affinity", "track_count")


def nearest(taste: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """The `n` vectors nearest to a one-row table's `q`: file_id, score and rank from 1."""
    scored = normalized(vectors).crossJoin(F.broadcast(taste.select("q").limit(1))).select("file_id", F.round(dot(F.col("vector_n"), F.col("q")), 6).alias("score"))
    best = scored.orderBy(F.col("score").desc(), "file_id").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "file_id")))


def _first(ranked: DataFrame, n: int) -> DataFrame:
    return ranked.orderBy("rank").limit(n).select("file_id", "score", "rank")


def _played(own: DataFrame) -> DataFrame:
    return own.select(F.col("nd_id").alias("file_id")).distinct()


def familiar(own: DataFrame, taste: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """Of the 5 n nearest tracks the first n that the user has played."""
    return _first(nearest(taste, vectors, 5 * n).join(_played(own), "file_id", "left_semi"), n)


def discovery(own: DataFrame, taste: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """Of the 2 n nearest tracks the first n that the user has not played."""
    return _first(nearest(taste, vectors, 2 * n).join(_played(own), "file_id", "left_anti"), n)


def hidden_gems(own: DataFrame, taste: DataFrame, vectors: DataFrame, tags: DataFrame, n: int) -> DataFrame:
    """Of the 3 n nearest tracks the first n that the user has not played, by artists of whom the user has played nothing."""
    artists = tags.where("rel = 'artist' AND value_str IS NOT NULL").select("file_id", "value_str")
    known = artists.join(_played(own), "file_id", "left_semi").select("value_str").distinct()
    heard = artists.join(known, "value_str", "left_semi").select("file_id")
    new = nearest(taste, vectors, 3 * n).join(_played(own), "file_id", "left_anti")
    return _first(new.join(heard, "file_id", "left_anti"), n)


def universal(taste: DataFrame, vectors: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """Every so many of the 3 n nearest tracks, n in all; in order, or shuffled by a seed."""
    found = nearest(taste, vectors, 3 * n)
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy()) / n))
    out = _first(found.withColumn("step", step).where("(rank - 1) % step = 0"), n)
    return out if seed is None else out.orderBy(F.rand(seed))


def genre_playlists(own: DataFrame, vectors: DataFrame, tags: DataFrame, now: str, n: int, most: int = 25, least_songs: int = 100, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """For each of the user's `most` genres of the largest weight the n tracks of the genre nearest to the genre's own centroid; genres with fewer than `least_songs` tracks found are left out.

    Genres are few rows and are broadcast behind that bound; tracks stay where
    they are and are pruned by rank within a genre before they are shuffled.
    """
    genres = tags.where("rel = 'genre' AND value_str IS NOT NULL").select("file_id", F.col("value_str").alias("genre")).distinct()
    played = taste_weights(own, now, half_life).join(vectors.select(F.col("file_id").alias("nd_id"), "vector"), "nd_id")
    weighted = played.join(genres.withColumnRenamed("file_id", "nd_id"), "nd_id")
    top = _centroid(weighted, ["genre"]).orderBy(F.round("affinity", 9).desc(), "genre").limit(most).select("genre", "q")
    scored = normalized(vectors).join(genres, "file_id").join(F.broadcast(top), "genre").select("genre", "file_id", F.round(dot(F.col("vector_n"), F.col("q")), 6).alias("score"))
    w = Window.partitionBy("genre").orderBy(F.col("score").desc(), "file_id")
    found = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 3 * n)
    enough = found.groupBy("genre").agg(F.count("*").alias("found")).where(F.col("found") >= least_songs).select("genre")
    return found.where(F.col("rank") <= n).join(enough, "genre", "left_semi").select("genre", "file_id", "score", "rank")


def playlists(own: DataFrame, vectors: DataFrame, tags: DataFrame, now: str, n: int, least: int, kinds: tuple[str, ...] = ("familiar", "discovery", "hidden_gems", "universal")) -> DataFrame:
    """playlist, file_id and rank of the kinds asked for; lists of fewer than `least` tracks are left out."""
    taste = profile(own, vectors, now)
    built = {
        "familiar": lambda: familiar(own, taste, vectors, n),
        "discovery": lambda: discovery(own, taste, vectors, n),
        "hidden_gems": lambda: hidden_gems(own, taste, vectors, tags, n),
        "universal": lambda: universal(taste, vectors, n),
    }
    each = [built[k]().select(F.lit(k).alias("playlist"), "file_id", "rank") for k in kinds]
    every = functools.reduce(DataFrame.union, each)
    enough = F.count("*").over(Window.partitionBy("playlist"))
    return every.withColumn("size", enough).where(F.col("size") >= least).drop("size")
