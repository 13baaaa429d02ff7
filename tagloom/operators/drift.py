"""How far two calibrations are apart: percentiles, distributions, centre and spread. Scores have `side` (old or new) and `v`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

JSD_BINS = 100
#: Fixed value: a calibration has settled if both percentiles moved by less.
SETTLED = 0.01


def percentile_drift(history: DataFrame) -> DataFrame:
    """Per key its latest run against the one before: absolute percentile drift, drift of the range, and whether it has settled. History has key, run, p5 and p95."""
    w = Window.partitionBy("key").orderBy("run")
    before = history.withColumn("b5", F.lag("p5").over(w)).withColumn("b95", F.lag("p95").over(w))
    latest = before.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(F.col("run").desc()))).where("nth = 1 and b5 is not null")
    d5, d95 = F.abs(F.col("p5") - F.col("b5")), F.abs(F.col("p95") - F.col("b95"))
    span = F.abs((F.col("p95") - F.col("p5")) - (F.col("b95") - F.col("b5")))
    return latest.select("key", F.round(d5, 6).alias("apd_p5"), F.round(d95, 6).alias("apd_p95"), F.round(span, 6).alias("srd"), ((d5 < SETTLED) & (d95 < SETTLED)).alias("settled"))


def divergence(scores: DataFrame) -> DataFrame:
    """One row: the Jensen-Shannon divergence (natural logarithm) of the two sides over equal bins of [0, 1]; values outside are left out."""
    at = F.least(F.floor(F.col("v") * JSD_BINS), F.lit(JSD_BINS - 1))
    bins = scores.where("v between 0 and 1").groupBy(at.alias("bin")).agg(F.count_if(F.col("side") == "old").alias("o"), F.count_if(F.col("side") == "new").alias("n"))
    all_bins = Window.partitionBy()  # of JSD_BINS rows at most
    share = bins.select((F.col("o") / F.sum("o").over(all_bins)).alias("p"), (F.col("n") / F.sum("n").over(all_bins)).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / F.col("m"))).otherwise(0.0)
    return share.agg(F.round(F.sum((part("p") + part("q")) / 2), 6).alias("jsd"))


def centre_and_spread(scores: DataFrame) -> DataFrame:
    """One row: by how much the median and the interquartile range moved, both exact, with linear interpolation."""
    of = lambda side: F.percentile(F.when(F.col("side") == side, F.col("v")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(side)
    q = scores.agg(of("old"), of("new"))
    return q.select(F.round(F.abs(F.col("new")[1] - F.col("old")[1]), 6).alias("median_drift"), F.round(F.abs((F.col("new")[2] - F.col("new")[0]) - (F.col("old")[2] - F.col("old")[0])), 6).alias("iqr_drift"))
