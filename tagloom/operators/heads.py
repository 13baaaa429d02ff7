"""Decisions of classification heads from a file's label probabilities: file_id, label, p and std, one row a label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tier, least probability, least ratio to and gap from the counter-label, and the deviation from which on the tier is out of reach.
CASCADE = [("high", 0.80, 1.2, 0.15, 0.08), ("medium", 0.75, 1.1, 0.08, 0.15), ("low", 0.60, 1.02, 0.03, 0.25)]
EPS = 1e-9


def tier(p: Column, counter: Column, std: Column) -> Column:
    """The first tier whose bounds all hold, else null; an unknown deviation bars none."""
    ratio, gap, found = p / F.greatest(counter, F.lit(EPS)), p - counter, F.lit(None).cast("string")
    for name, least, ratio_least, gap_least, unsteady in reversed(CASCADE):
        found = F.when((p >= least) & (ratio >= ratio_least) & (gap >= gap_least) & (std.isNull() | (std < unsteady)), name).otherwise(found)
    return found


def decide(scores: DataFrame) -> DataFrame:
    """The labels that get a tier, with their counter-confidence.

    That is the probability of the label's negation (non_ or not_), else the
    largest of the file's other labels, 0 for a lone label. A file has as many
    rows as its head has labels, so that they fit in one array.
    """
    every = F.collect_list(F.struct("label", "p")).over(Window.partitionBy("file_id"))
    named = lambda prefix: F.array_max(F.transform(F.filter("every", lambda x: x["label"] == F.concat(F.lit(prefix), F.col("label"))), lambda x: x["p"]))
    others = F.array_max(F.transform(F.filter("every", lambda x: x["label"] != F.col("label")), lambda x: x["p"]))
    counter = F.coalesce(named("non_"), named("not_"), others, F.lit(0.0))
    full = scores.where("p is not null").withColumn("every", every).withColumn("counter", F.least(F.greatest(counter, F.lit(0.0)), F.lit(1.0)))
    return full.select("file_id", "label", "p", "counter", tier(F.col("p"), F.col("counter"), F.col("std")).alias("tier")).where("tier is not null")


def decide_all(scores: DataFrame, thresholds: dict[str, float] | None = None, least: float = 0.0, two: bool = False) -> DataFrame:
    """All labels with their probability, and the tier of those that are selected (null for the others).

    A label is selected from its threshold on (CASCADE's lowest where it has
    none), and from `least` on. With `two` the counter-confidence is the largest
    of the other labels, whatever their names.
    """
    own = F.create_map(*(F.lit(x) for pair in (thresholds or {"": 0.0}).items() for x in pair))[F.col("label")]
    allowed = (F.col("p") >= F.coalesce(own, F.lit(CASCADE[-1][1]))) & (F.col("p") >= least)
    every = F.collect_list(F.struct("label", "p")).over(Window.partitionBy("file_id"))
    others = F.array_max(F.transform(F.filter("every", lambda x: x["label"] != F.col("label")), lambda x: x["p"]))
    full = scores.where("p is not null")
    if two:
        counter = F.least(F.greatest(F.coalesce(others, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        full = full.withColumn("every", every).withColumn("counter", counter)
        found = tier(F.col("p"), F.col("counter"), F.col("std"))
        return full.select("file_id", "label", "p", F.when(allowed, found).alias("tier"))
    tiers = decide(scores).select("file_id", "label", F.col("tier").alias("found"))
    return full.join(tiers, ["file_id", "label"], "left").select("file_id", "label", "p", F.when(allowed, F.col("found")).alias("tier"))


def as_tags(decided: DataFrame, prefix: str) -> DataFrame:
    """The probabilities as numeric tags: file_id, rel and value_num."""
    return decided.select("file_id", F.concat(F.lit(prefix), "label").alias("rel"), F.lit(None).cast("string").alias("value_str"), F.col("p").alias("value_num"))


def reconstructed(tags: DataFrame, stats: DataFrame, states: DataFrame, head: str) -> DataFrame:
    """What `decide` takes, made again from stored tags: each label's probability (file_id, label, value) and segment deviation (file_id, label, std), both scaled by the label's calibration where it has one."""
    c = states.where(F.col("head_name") == head).select("label", "p5", "p95")
    both = tags.join(stats, ["file_id", "label"], "left").join(c, "label", "left")
    span = F.col("p95") - F.col("p5")
    scaled = F.when(span > 0, F.least(F.greatest((F.col("value") - F.col("p5")) / span, F.lit(0.0)), F.lit(1.0))).otherwise(F.col("value"))
    return both.select("file_id", "label", scaled.alias("p"), (F.coalesce("std", F.lit(0.0)) * F.when(span > 0, 1 / span).otherwise(1.0)).alias("std"))
