"""Figures of tags and moods: types, frequencies, distributions, correlations, an artist's profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import field_name, is_versioned, short_name


def _text() -> Column:
    return F.coalesce("value_str", F.col("value_num").cast("string"))


def type_stats(tags: DataFrame) -> DataFrame:
    """Per rel its type (float if more than half of its different values are numbers, else string), whether it has several values, a summary of them, and its number of edges.

    One aggregation of edges by value, one of values by rel.
    """
    values = tags.groupBy("rel", "value_str", "value_num").agg(F.count("*").alias("edges"))
    per = values.groupBy("rel").agg(F.count("*").alias("n"), F.count("value_num").alias("nums"), F.min("value_num").alias("lo"), F.max("value_num").alias("hi"), F.sum("edges").alias("total_count"))
    numeric = F.col("nums") * 2 > F.col("n")
    numbers = F.concat(F.lit("min="), F.col("lo").cast("string"), F.lit(", max="), F.col("hi").cast("string"), F.lit(", unique="), F.col("nums").cast("string"))
    return per.select("rel", F.when(numeric, "float").otherwise("string").alias("type"), (F.col("n") > 1).alias("is_multivalue"), F.when(numeric, numbers).otherwise(F.concat(F.lit("unique="), F.col("n").cast("string"))).alias("summary"), "total_count")


def preview(tags: DataFrame, prefix: str = "nom:") -> DataFrame:
    """The statistics of a namespace's rels with their short and field names."""
    short = short_name(F.col("rel"), F.col("type") != "string")
    return type_stats(tags.where(F.col("rel").startswith(prefix))).select("*", short.alias("short_name"), field_name(short).alias("field"), is_versioned(F.col("rel")).alias("versioned"))


def frequencies(tags: DataFrame, prefix: str, n: int) -> DataFrame:
    """kind, name and song_count of the most frequent key:value of a namespace (kind own) and of genres (kind genre), n of each; ties by name."""
    own = F.when(F.col("rel").startswith(prefix), "own").when(F.col("rel") == "genre", "genre")
    name = F.when(F.col("rel") == "genre", _text()).otherwise(F.concat(F.substring("rel", len(prefix) + 1, 1 << 20), F.lit(":"), _text()))
    counts = tags.select(own.alias("kind"), name.alias("name"), "file_id").where("kind is not null and name is not null").groupBy("kind", "name").agg(F.countDistinct("file_id").alias("song_count"))
    w = Window.partitionBy("kind").orderBy(F.col("song_count").desc(), "name")
    return counts.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).drop("nth")


def mood_distribution(edges: DataFrame, per_tier: int = 20, overall: int = 30) -> DataFrame:
    """tier, mood, n and pct: the most frequent moods of each tier, and of all (tier all), with their share of those listed, in per cent."""
    counts = edges.groupBy(F.substring("rel", 5, 100).alias("tier"), F.col("value_str").alias("mood")).agg(F.count("*").alias("n"))
    every = counts.groupBy("mood").agg(F.sum("n").alias("n")).select(F.lit("all").alias("tier"), "mood", "n")
    w = Window.partitionBy("tier").orderBy(F.col("n").desc(), "mood")
    most = F.when(F.col("tier") == "all", overall).otherwise(per_tier)
    top = counts.union(every).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    return top.select("tier", "mood", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("tier")), 2).alias("pct"))


def _top_moods(edges: DataFrame, n: int) -> DataFrame:
    """The files of the n most frequent moods: mood, m (its files) and file_id. n is a handful of rows, which are broadcast."""
    own = edges.select("file_id", F.col("value_str").alias("mood")).distinct()
    top = own.groupBy("mood").agg(F.count("*").alias("m")).orderBy(F.col("m").desc(), "mood").limit(n)
    return own.join(F.broadcast(top), "mood")


def _best(pairs: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("mood").orderBy(F.col("p").desc(), "other")
    return pairs.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).select("mood", "other", "p")


def top_correlation(edges: DataFrame, top_n: int, each: int = 10) -> DataFrame:
    """P(other | mood) among the top_n moods, to three decimals, the largest of each mood."""
    own = _top_moods(edges, top_n)
    both = own.join(own.select("file_id", F.col("mood").alias("other")), "file_id").where("mood <> other")
    # moods that never meet have 0
    pairs = own.select("mood", "m").distinct().join(own.select(F.col("mood").alias("other")).distinct(), F.col("mood") != F.col("other"))
    counts = both.groupBy("mood", "other").agg(F.count("*").alias("n"))
    return _best(pairs.join(counts, ["mood", "other"], "left").select("mood", "other", F.round(F.coalesce("n", F.lit(0)) / F.col("m"), 3).alias("p")), each)


def tier_correlation(edges: DataFrame, tiers: DataFrame, top_n: int, each: int = 10) -> DataFrame:
    """P(value of a tier tag | mood): tier tags have file_id, rel (like nom:bright_tier) and value_str; the other is value_name."""
    name = F.element_at(F.split(F.replace(F.replace("rel", F.lit("nom:"), F.lit("")), F.lit("_tier"), F.lit("")), "_"), -1)
    tags = tiers.where(F.col("rel").like("%_tier")).select("file_id", F.concat("value_str", F.lit("_"), name).alias("other"))
    counts = _top_moods(edges, top_n).join(tags, "file_id").groupBy("mood", "other").agg((F.count("*") / F.max("m")).alias("p"))
    return _best(counts.withColumn("p", F.round("p", 3)), each)


def artist_profile(tags: DataFrame, artist: str, prefix: str = "nom:", n: int = 20) -> DataFrame:
    """kind, name, n and average: an artist's most frequent tags with the average of their numbers (kind tag), 15 moods (kind mood), and files with tags a file (kind files)."""
    songs = tags.where((F.col("rel") == "artist") & (F.col("value_str") == artist)).select("file_id").distinct()
    own = tags.where(F.col("rel").startswith(prefix)).join(songs, "file_id", "left_semi").withColumn("name", F.substring("rel", len(prefix) + 1, 1 << 20))
    is_mood = F.col("name").isin("mood-strict", "mood-regular", "mood-loose")
    kind = F.when(is_mood, "mood").otherwise("tag")
    counts = own.groupBy(kind.alias("kind"), F.when(is_mood, F.col("value_str")).otherwise(F.col("name")).alias("name")).agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("value_num"), F.lit(0.0)), 4).alias("average"))
    w = Window.partitionBy("kind").orderBy(F.col("n").desc(), "name")
    top = counts.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= F.when(F.col("kind") == "mood", 15).otherwise(n)).drop("nth")
    # both totals are one row
    total = songs.agg(F.count("*").alias("n")).crossJoin(own.where(~is_mood).agg(F.count("*").alias("t")))
    return top.union(total.select(F.lit("files"), F.lit(artist), "n", F.round(F.when(F.col("n") > 0, F.col("t") / F.col("n")).otherwise(0.0), 4)))


def files_with(tags: DataFrame, prefix: str) -> DataFrame:
    return tags.where(F.col("rel").startswith(prefix)).agg(F.countDistinct("file_id").alias("n_files"))


def first_values(tags: DataFrame, rel: str, limit: int) -> DataFrame:
    """Different values of the first `limit` tags of a rel, in their order: the limit is taken before repetitions go."""
    return tags.where((F.col("rel") == rel) & F.col("value_str").isNotNull()).select("value_str").orderBy("value_str").limit(limit).distinct()


def head_summary(stats: DataFrame) -> DataFrame:
    """One row of a head's statistics (file_id, n, label_stats): files, the average deviation over all labels, and the least and most segments. Averages of arrays are taken before files meet, so that no file counts by its labels."""
    total = F.aggregate("label_stats", F.lit(0.0), lambda s, x: s + x["std"])
    per = stats.select("n", total.alias("s"), F.size("label_stats").alias("labels"))
    return per.agg(F.count("*").alias("file_count"), F.round(F.sum("s") / F.sum("labels"), 6).alias("avg_std"), F.min("n").alias("min_segments"), F.max("n").alias("max_segments"))


def unsteady(stats: DataFrame, label: str, least: float) -> DataFrame:
    """Files of a head's statistics where a label's deviation is larger, with that label's figures."""
    hit = F.filter("label_stats", lambda x: (x["label"] == label) & (x["std"] > least))
    return stats.withColumn("hit", hit).where(F.size("hit") > 0).select("file_id", F.inline("hit"))
