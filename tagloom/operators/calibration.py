"""Calibration of all labels in one plan, its history, and mood outputs of heads.

Scores have head_name, label, file_id and value; a state has head_name, label,
p5, p95 and n; a history has calibration_key, snapshot_at and the same figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import state_key
from .scores import BINS, HI, LO

#: From which figures on a calibration is not stable.
DRIFT_LIMITS = {"apd_p5": 0.01, "apd_p95": 0.01, "srd": 0.05, "jsd": 0.1, "median_drift": 0.05, "iqr_drift": 0.1}
#: Bounds of the mean beyond which a regression head says one of its terms, and of the deviation below which it is very stable, stable and acceptable.
HIGH_MEAN, LOW_MEAN = 0.7, 0.3
VERY_STABLE, STABLE, ACCEPTABLE = 0.08, 0.15, 0.25


def histograms(scores: DataFrame) -> DataFrame:
    """The sparse histograms of all labels at once: head_name, label, bin, n, underflow, overflow. Values beyond the ends fall into the end bins and are counted besides."""
    width = (HI - LO) / BINS
    at = F.least(F.greatest(F.floor((F.col("value") - LO) / F.lit(width)), F.lit(0)), F.lit(BINS - 1)).cast("long")
    return scores.groupBy("head_name", "label", at.alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("value") < LO).alias("underflow"), F.count_if(F.col("value") > HI).alias("overflow"))


def states(hist: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """The percentiles of all labels from their histograms: the lower edge of the bin where the cumulative count reaches the share.

    The cumulative count starts at the underflow, which is in the first bin as
    well and so counts twice, as it does in the system this stands in for. A
    label has BINS rows at most, so that a window by label is bounded.
    """
    width = (HI - LO) / BINS
    own = Window.partitionBy("head_name", "label")
    cum = F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) + F.sum("underflow").over(own)
    run = hist.withColumn("cum", cum).withColumn("total", F.sum("n").over(own))
    reach = lambda q, end: F.round(F.coalesce(F.min(F.when(F.col("cum") >= F.col("total") * q, F.col("bin"))) * width + LO, F.lit(end)), 6)
    return run.groupBy("head_name", "label").agg(reach(low, LO).alias("p5"), reach(high, HI).alias("p95"), F.sum("n").alias("n"), F.sum("underflow").alias("underflow_count"), F.sum("overflow").alias("overflow_count"))


def fingerprint(states: DataFrame) -> DataFrame:
    """One row: a hash of all calibrations, in the order of their keys; percentiles are written with six decimals. States are a row a label."""
    line = F.concat_ws(":", state_key(F.col("head_name"), F.col("label")), F.format_string("%.6f", "p5"), F.format_string("%.6f", "p95"))
    return states.agg(F.md5(F.array_join(F.array_sort(F.collect_list(line)), "|")).alias("version"))


def snapshots(before: DataFrame, now: DataFrame, at: int) -> DataFrame:
    """The snapshots that a run at a time adds to the history: figures and how far they are from each key's latest ones."""
    last = latest(before).select("calibration_key", F.col("p5").alias("b5"), F.col("p95").alias("b95"), F.col("n").alias("bn"))
    return now.join(last, "calibration_key", "left").select("calibration_key", F.lit(at).cast("long").alias("snapshot_at"), "p5", "p95", "n", F.round(F.col("p5") - F.col("b5"), 6).alias("p5_delta"), F.round(F.col("p95") - F.col("b95"), 6).alias("p95_delta"), (F.col("n") - F.col("bn")).alias("n_delta"))


def latest(history: DataFrame, n: int = 1) -> DataFrame:
    """The latest n snapshots of each key."""
    w = Window.partitionBy("calibration_key").orderBy(F.col("snapshot_at").desc())
    return history.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).drop("nth")


def recent(history: DataFrame, limit: int, key: str | None = None, since: int | None = None) -> DataFrame:
    """The latest snapshots of one key or of all, from a time on."""
    own = history if key is None else history.where(F.col("calibration_key") == key)
    own = own if since is None else own.where(F.col("snapshot_at") >= since)
    return own.orderBy(F.col("snapshot_at").desc(), "calibration_key").limit(limit)


def last_per_label(states: DataFrame) -> DataFrame:
    """label, p5 and p95: of several heads with a label the last by name counts."""
    w = Window.partitionBy("label").orderBy(F.col("head_name").desc())
    return states.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("label", "head_name", "p5", "p95")


def applied(scores: DataFrame, states: DataFrame) -> DataFrame:
    """Each score scaled by its label's calibration, as it is without one. States are a row a label: Spark broadcasts them by their size."""
    scale = F.least(F.greatest((F.col("value") - F.col("p5")) / (F.col("p95") - F.col("p5")), F.lit(0.0)), F.lit(1.0))
    some = scores.join(states.select("head_name", "label", "p5", "p95"), ["head_name", "label"], "left")
    return some.select("head_name", "label", "file_id", F.when(F.col("p95") > F.col("p5"), scale).otherwise(F.col("value")).alias("value"))


def compared(drift: DataFrame, limits: dict[str, float] = DRIFT_LIMITS) -> DataFrame:
    """With failed_metrics (comma-joined, in the order of the limits) and is_stable, from a row with all figures."""
    failed = F.array_compact(F.array(*(F.when(F.col(m) > v, F.lit(m)) for m, v in limits.items())))
    return drift.withColumn("failed_metrics", F.array_join(failed, ",")).withColumn("is_stable", F.size(failed) == 0)


def regression_outputs(stats: DataFrame, terms: dict[str, tuple[str, str]]) -> DataFrame:
    """head_name, file_id, label, value and tier from a regression head's mean and std; `terms` has each head's high and low term.

    Heads without terms give nothing.
    """
    names = F.create_map(*(x for h, (a, b) in terms.items() for x in (F.lit(h), F.array(F.lit(a), F.lit(b)))))
    own = stats.withColumn("term", names[F.col("head_name")])
    return regression_terms(own.withColumns({"high_term": F.get("term", F.lit(0)), "low_term": F.get("term", F.lit(1))}))


def regression_terms(stats: DataFrame) -> DataFrame:
    """The same from rows that carry their high_term and low_term.

    A mean that is neither high nor low gives both terms without a tier. A term
    is high, medium or low by how steady and how far from the middle it is.
    """
    m = F.least(F.greatest("mean", F.lit(0.0)), F.lit(1.0))
    own = stats.withColumn("m", m).where("high_term is not null and low_term is not null")
    intensity = F.abs(F.col("m") - 0.5) * 2
    tier = F.when(F.col("std") >= ACCEPTABLE, F.lit(None)).when((F.col("std") < VERY_STABLE) & (intensity >= 0.8), "high").when((F.col("std") < STABLE) & (intensity >= 0.6), "medium").otherwise("low")
    one = lambda term, value, t: F.struct(F.col(term).alias("label"), value.alias("value"), t.cast("string").alias("tier"))
    none = F.lit(None).cast("string")
    high, low = F.col("m") >= HIGH_MEAN, F.col("m") <= LOW_MEAN
    out = F.when(high, F.array(one("high_term", F.col("m"), tier))).when(low, F.array(one("low_term", F.col("m"), tier))).otherwise(F.array(one("high_term", F.col("m"), none), one("low_term", 1 - F.col("m"), none)))
    return own.select("head_name", "file_id", F.inline(out))


def tier_rank(tier: Column) -> Column:
    return F.when(tier.isin("high", "strict"), 3).when(tier.isin("medium", "norm", "normal"), 2).when(tier == "low", 1).otherwise(0)


def opponents(models: DataFrame) -> DataFrame:
    """Pairs of labels (label, other) that a model (model, label) has together."""
    other = models.select("model", F.col("label").alias("other"))
    return models.join(other, "model").where("label <> other").select("label", "other").distinct()


def unsuppressed(outputs: DataFrame, against: DataFrame) -> DataFrame:
    """The tiered outputs that stay: of each head's the strongest, and of two heads' that contradict each other neither.

    Outputs of a file are looked at in the order of model_key; one that is
    suppressed already suppresses no other. `against` (label, other) is a table
    of labels. A file has as many rows as there are heads, so that the pass over
    them is one array.
    """
    strongest = Window.partitionBy("file_id", "head_name").orderBy(tier_rank(F.col("tier")).desc(), F.col("value").desc(), "model_key")
    best = outputs.where("tier is not null").withColumn("nth", F.row_number().over(strongest)).where("nth = 1")
    foes = against.groupBy("label").agg(F.collect_set("other").alias("foes"))
    own = best.join(foes, "label", "left")
    one = F.struct("model_key", "head_name", "label", "value", "tier", F.coalesce("foes", F.array().cast("array<string>")).alias("foes"))
    rows = own.groupBy("file_id").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    # the keys that are out so far; each row that is in yet takes out itself and all later foes that are in yet
    out = F.array().cast("array<string>")

    def step(gone: Column, a: Column) -> Column:
        later = F.filter("rows", lambda b: (b["model_key"] > a["model_key"]) & ~F.array_contains(gone, b["model_key"]) & F.array_contains(a["foes"], b["label"]) & (b["head_name"] != a["head_name"]))
        keys = F.transform(later, lambda b: b["model_key"])
        return F.when(F.array_contains(gone, a["model_key"]) | (F.size(later) == 0), gone).otherwise(F.concat(gone, F.array(a["model_key"]), keys))

    kept = rows.withColumn("gone", F.aggregate("rows", out, step))
    stays = F.filter("rows", lambda r: ~F.array_contains(F.col("gone"), r["model_key"]))
    return kept.select("file_id", F.inline(stays)).drop("foes")


def mood_tags(outputs: DataFrame) -> DataFrame:
    """Per file and tier (strict, regular, loose) its labels, sorted and joined by |; a tier holds the stricter ones' as well."""
    least = F.when(F.col("tier").isin("high", "strict"), 0).when(F.col("tier").isin("medium", "norm", "normal"), 1).otherwise(2)
    names = F.array(*(F.lit(f"mood-{t}") for t in ("strict", "regular", "loose")))
    each = outputs.select("file_id", "label", F.explode(F.sequence(least, F.lit(2))).alias("i"))
    return each.groupBy("file_id", F.get(names, "i").alias("rel")).agg(F.array_join(F.array_sort(F.collect_set("label")), "|").alias("moods"))
