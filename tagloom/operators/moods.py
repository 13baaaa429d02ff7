"""Mood tiers: coverage, balance, pairs, vibes and correlation. Edges have file_id, rel and value_str."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = ("strict", "regular", "loose")
PREFIX = "nom:mood-"


def tier_rels(tier: str) -> list[str]:
    """A tier includes the stricter ones."""
    return [PREFIX + t for t in TIERS[: TIERS.index(tier) + 1]]


def coverage(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Per tier the files that have a mood, and their share in percent; the total is one row, which Spark pre-aggregates."""
    total = files.agg(F.count("*").alias("total"))
    tagged = edges.groupBy("rel").agg(F.countDistinct("file_id").alias("tagged"))
    return tagged.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one").select("rel", "tagged", F.round(100.0 * F.col("tagged") / F.col("total"), 1).alias("pct"))


def balance(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel", F.col("value_str").alias("mood")).agg(F.count("*").alias("n"))


def pairs(edges: DataFrame, tier: str) -> DataFrame:
    """How many files have both moods within the tier; a file has few moods, so that pairs form within a file's own array."""
    own = edges.where(F.col("rel").isin(tier_rels(tier))).groupBy("file_id").agg(F.array_sort(F.collect_set("value_str")).alias("m"))
    each = own.select(F.explode(F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("mood1"), y.alias("mood2"))))) ).alias("p"))
    return each.groupBy("p.mood1", "p.mood2").agg(F.count("*").alias("n_files"))


def dominant(edges: DataFrame, n: int = 5) -> DataFrame:
    sums = balance(edges).groupBy("mood").agg(F.sum("n").alias("n"))
    total = sums.agg(F.sum("n").alias("all")).withColumn("one", F.lit(1))
    return sums.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("mood", "n", F.round(100.0 * F.col("n") / F.col("all"), 1).alias("pct")).orderBy(F.col("n").desc(), "mood").limit(n)


def correlation(edges: DataFrame) -> DataFrame:
    """P(other | mood): of the files with a mood, the share that has the other."""
    own = edges.select("file_id", "value_str").distinct()
    both = own.select("file_id", F.col("value_str").alias("mood")).join(own.select("file_id", F.col("value_str").alias("other")), "file_id").where("mood <> other").groupBy("mood", "other").agg(F.count("*").alias("n"))
    each = own.groupBy(F.col("value_str").alias("mood")).agg(F.count("*").alias("m"))
    return both.join(each, "mood").select("mood", "other", F.round(F.col("n") / F.col("m"), 6).alias("p"))


def inclusive(edges: DataFrame) -> DataFrame:
    """Per file and tier its moods, sorted and joined by |: a tier holds those of the stricter ones too."""
    tiers = F.create_map(*(F.lit(x) for t in TIERS for x in (PREFIX + t, TIERS.index(t))))
    dealt = edges.select("file_id", "value_str", F.explode(F.sequence(tiers[F.col("rel")], F.lit(len(TIERS) - 1))).alias("i"))
    names = F.array(*(F.lit(PREFIX + t) for t in TIERS))
    return dealt.groupBy("file_id", "i").agg(F.array_join(F.array_sort(F.collect_set("value_str")), "|").alias("moods")).select("file_id", F.get(names, "i").alias("rel"), "moods")


def of_library(edges: DataFrame, files: DataFrame, library: int | None) -> DataFrame:
    """The edges of one library's files, or all."""
    return edges if library is None else edges.join(files.where(F.col("library_id") == library).select("file_id"), "file_id", "left_semi")


def top_pairs(edges: DataFrame, tier: str, n: int) -> DataFrame:
    """The n pairs of moods that most files have; ties by name."""
    return pairs(edges, tier).orderBy(F.desc("n_files"), "mood1", "mood2").limit(n)


def files_of_moods(edges: DataFrame, specs: DataFrame) -> DataFrame:
    """tier, mood and file_id of the files that have a specified mood (tier, mood) in its tier or a stricter one."""
    wanted = specs.withColumn("rel", F.explode(F.create_map(*(x for t in TIERS for x in (F.lit(t), F.array(*map(F.lit, tier_rels(t))))))[F.col("tier")]))
    met = edges.withColumnRenamed("value_str", "mood").join(wanted, ["rel", "mood"])
    return met.select("tier", "mood", "file_id").distinct()


def analysis(edges: DataFrame, files: DataFrame, tier: str = "strict", n: int = 10, library: int | None = None) -> dict[str, DataFrame]:
    """All of a library's mood figures: coverage and balance by tier, the n most common pairs, and the n commonest moods."""
    own = of_library(edges, files, library)
    some = files if library is None else files.where(F.col("library_id") == library)
    return {"coverage": coverage(own, some), "balance": balance(own), "top_pairs": top_pairs(own, tier, n), "dominant": dominant(own, n)}
