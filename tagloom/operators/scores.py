"""Score pooling, head decisions and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a histogram over [LO, HI].
BINS, LO, HI = 10_000, 0.0, 1.0


def segment_stats(segments: DataFrame, score: str) -> DataFrame:
    """Per file: number, mean, population deviation, least and largest of a head's segment scores."""
    return segments.groupBy("file_id").agg(F.count(score).alias("n"), F.round(F.avg(score), 6).alias("mean"), F.round(F.stddev_pop(score), 6).alias("std"), F.min(score).alias("least"), F.max(score).alias("largest"))


def high_variance(stats: DataFrame, least: float) -> DataFrame:
    return stats.where(F.col("std") > least)


def trimmed_mean(segments: DataFrame, score: str, trim: float = 0.1) -> DataFrame:
    """Per file the mean without the smallest and largest share of its segments; the number cut follows from all of them."""
    w = Window.partitionBy("file_id")
    ranked = segments.select("file_id", F.col(score).alias("x"), F.row_number().over(w.orderBy(score, "segment_id")).alias("r"), F.count("*").over(w).alias("n"))
    cut = F.floor(F.col("n") * trim)
    return ranked.where((F.col("r") > cut) & (F.col("r") <= F.col("n") - cut)).groupBy("file_id").agg(F.round(F.avg("x"), 6).alias("pooled"), F.count("*").alias("used"))


def tier(mean: Column, std: Column) -> Column:
    """high, low or none by the mean; strict, regular or loose by how steady it is."""
    side = F.when(mean >= 0.7, "high").when(mean <= 0.3, "low").otherwise("none")
    level = F.when(std < 0.1, "strict").when(std < 0.2, "regular").when(std < 0.35, "loose").otherwise("untiered")
    return F.concat_ws(":", side, level)


def histogram(values: DataFrame, value: str) -> DataFrame:
    """Sparse: bin and count. Values at HI fall into the last bin, as do those beyond, which are counted besides; so at the other end."""
    width = (HI - LO) / BINS
    at = F.least(F.greatest(F.floor((F.col(value) - LO) / F.lit(width)), F.lit(0)), F.lit(BINS - 1)).cast("long")
    return values.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.when(F.col(value) < LO, 1).otherwise(0)).alias("underflow"), F.sum(F.when(F.col(value) > HI, 1).otherwise(0)).alias("overflow"))


def percentiles(hist: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """One row: the lower edges of the bins where the cumulative count reaches the shares. It starts at the underflow, which so counts twice. At most BINS rows are summed in order."""
    width = (HI - LO) / BINS
    run = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) + F.sum("underflow").over(Window.partitionBy())
    cum = hist.select("bin", run.alias("cum"), F.sum("n").over(Window.partitionBy()).alias("total"))
    reach = lambda q: F.min(F.when(F.col("cum") >= F.col("total") * q, F.col("bin")))
    return cum.agg(F.round(F.coalesce(reach(low) * width + LO, F.lit(LO)), 6).alias("p5"), F.round(F.coalesce(reach(high) * width + LO, F.lit(HI)), 6).alias("p95"), F.max("total").alias("n"))


def calibrated(x: Column, p5: Column, p95: Column) -> Column:
    """Scaled to [0, 1]; the value itself where there is no range."""
    scaled = F.least(F.greatest((x - p5) / (p95 - p5), F.lit(0.0)), F.lit(1.0))
    return F.when(p5.isNull() | p95.isNull() | (p95 <= p5), x).otherwise(scaled)


def pool_scores(segments: DataFrame, mode: str = "mean", trim: float = 0.1, omit: bool = True) -> DataFrame:
    """file_id, dim and value: of each file's segments (file_id, scores, an array) one value a dimension; null elements count as NaN.

    `mode` is mean, median or trimmed_mean. With `omit` NaN is left out, and a
    dimension of nothing else is 0; without it a dimension with NaN is NaN. The
    trimmed mean leaves NaN out either way, and cuts floor(trim * segments) at
    both ends, of all segments, with NaN or not; where that would leave none, it
    is the mean. Order statistics are ranks in a window: no file's scores are
    collected.
    """
    if mode not in ("mean", "median", "trimmed_mean"):
        raise ValueError(f"unknown pooling mode: {mode}")
    if not 0.0 <= trim < 0.5:
        raise ValueError("trim must be in [0, 0.5)")
    each = segments.select("file_id", F.posexplode(F.col("scores").cast("array<double>")).alias("dim", "x")).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    counts = lambda df: df.groupBy("file_id", "dim")
    missing = F.max(F.col("x").isNull())
    if mode == "mean":
        pooled = counts(each).agg(F.avg("x").alias("value"), missing.alias("odd"))
    else:
        w = Window.partitionBy("file_id", "dim")
        # nulls come last, so that the ranks of numbers are 1 to m
        ranked = each.withColumns({"r": F.row_number().over(w.orderBy(F.col("x").asc_nulls_last())), "n": F.count("*").over(w), "m": F.count("x").over(w)})
        cut = F.floor(F.col("n") * trim) if mode == "trimmed_mean" else F.floor((F.col("m") - 1) / 2)
        inside = (F.col("r") > cut) & (F.col("r") <= F.col("m") - cut) | (F.col("m") <= 2 * cut)
        pooled = counts(ranked).agg(F.avg(F.when(inside, F.col("x"))).alias("value"), missing.alias("odd"))
    value = F.coalesce("value", F.lit(0.0))
    if not omit and mode != "trimmed_mean":
        value = F.when(F.col("odd"), F.lit(float("nan"))).otherwise(value)
    return pooled.select("file_id", "dim", value.alias("value"))
