"""From stored scores to the mood tags that change: one plan over all heads and files, steered by a table of heads.

`heads` has a row for each label of a head: head_name, kind, label, threshold
(null: the lowest tier's) and, for regression heads, high_term and low_term.
`scores` has file_id, head_name, label and value; `stats` has file_id,
head_name, label, mean and std of the segments; `states` a row a label, with p5
and p95, under its plain name (`keys.plain_label`).

Calibration comes before any decision: values are scaled to p5..p95, deviations
by the same span. A head counts for a file that has statistics of it; a label
whose score is not stored counts as 0, one without deviation as steady.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import plain_label
from .calibration import mood_tags, regression_terms, unsuppressed
from .heads import CASCADE, tier

OUTPUT = ("file_id", "head_name", "model_key", "label", "value", "tier")
CLASSES = ("multiclass", "multilabel")


def model_key(head: Column, label: Column) -> Column:
    return F.concat(head, F.lit("/"), plain_label(label))


def _calibrated(rows: DataFrame, states: DataFrame, value: str) -> DataFrame:
    """With `value` scaled by its label's state and std by the same span. States are a row a label, so that Spark broadcasts them by their size."""
    own = rows.join(states.select(F.col("label").alias("plain"), "p5", "p95"), plain_label(F.col("label")) == F.col("plain"), "left")
    span = F.when(F.col("p95") > F.col("p5"), F.col("p95") - F.col("p5"))
    scaled = F.least(F.greatest((F.col(value) - F.col("p5")) / span, F.lit(0.0)), F.lit(1.0))
    return own.withColumns({value: F.when(span.isNotNull(), scaled).otherwise(F.col(value)), "std": F.col("std") / F.coalesce(span, F.lit(1.0))}).drop("plain", "p5", "p95")


def decided(rows: DataFrame) -> DataFrame:
    """The labels of classification heads (file_id, head_name, kind, label, threshold, p, std), by their head's kind: those selected with a tier, the others without.

    What speaks against a label is, in a multilabel head, its negation (non_ or
    not_) if the head has it, else the most probable other label, as in a
    multiclass head always. A head has few labels, which a window holds.
    """
    every = F.collect_list(F.struct("label", "p")).over(Window.partitionBy("file_id", "head_name"))
    most = lambda keep: F.array_max(F.transform(F.filter("every", keep), lambda x: x["p"]))
    named = lambda prefix: most(lambda x: x["label"] == F.concat(F.lit(prefix), F.col("label")))
    others = most(lambda x: x["label"] != F.col("label"))
    against = F.when(F.col("kind") == "multiclass", others).otherwise(F.coalesce(named("non_"), named("not_"), others))
    counter = F.least(F.greatest(F.coalesce(against, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    allowed = F.col("p") >= F.coalesce("threshold", F.lit(CASCADE[-1][1]))
    full = rows.withColumn("every", every).withColumn("counter", counter)
    found = F.when(allowed, tier(F.col("p"), F.col("counter"), F.col("std")))
    return full.select("file_id", "head_name", model_key(F.col("head_name"), F.col("label")).alias("model_key"), "label", F.col("p").alias("value"), found.alias("tier"))


def outputs(scores: DataFrame, stats: DataFrame, heads: DataFrame, states: DataFrame) -> DataFrame:
    """What all heads say of each file, as OUTPUT: each by its kind; heads of another kind say nothing."""
    regression = stats.join(heads.where("kind = 'regression'"), ["head_name", "label"])
    # of a regression head's statistics the first label's count
    first = Window.partitionBy("file_id", "head_name").orderBy("label")
    one = regression.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    terms = regression_terms(_calibrated(one, states, "mean")).withColumn("model_key", model_key(F.col("head_name"), F.col("label")))
    classes = heads.where(F.col("kind").isin(*CLASSES)).select("head_name", "kind", "label", "threshold")
    there = stats.select("file_id", "head_name").distinct().join(classes, "head_name")
    key = ["file_id", "head_name", "label"]
    full = there.join(scores.select(*key, F.col("value").alias("p")), key, "left").join(stats.select(*key, "std"), key, "left")
    # a score that is not stored is 0, whatever its calibration
    scaled = _calibrated(full.withColumn("std", F.coalesce("std", F.lit(0.0))), states, "p").withColumn("p", F.coalesce("p", F.lit(0.0)))
    return terms.select(*OUTPUT).unionByName(decided(scaled).select(*OUTPUT))


def calibrated_tags(scores: DataFrame, stats: DataFrame, heads: DataFrame, states: DataFrame, against: DataFrame) -> DataFrame:
    """file_id, rel and moods (sorted, joined by |) of each file, after contradictions (`against`: label, other) have been taken out."""
    return mood_tags(unsuppressed(outputs(scores, stats, heads, states).where("tier IS NOT NULL"), against))


def content_hash(tags: DataFrame, files: DataFrame) -> DataFrame:
    """file_id and the hash of each of `files`' tags (file_id, rel, moods), in the order of rel; files without tags have one too."""
    line = F.concat_ws("=", "rel", "moods")
    own = tags.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    return files.select("file_id").distinct().join(own, "file_id", "left").select("file_id", F.md5(F.coalesce("text", F.lit(""))).alias("content_hash"))


def changed(tags: DataFrame, files: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What has to be written: the hashes of the files of `files` whose tags differ from those that `stored` (file_id, content_hash) has, and these files' tags.

    A file without a stored hash has changed. One that has lost all tags is among
    the first and has none among the second: what is stored of it is to go.
    """
    was = stored.select("file_id", F.col("content_hash").alias("was"))
    new = content_hash(tags, files).join(was, "file_id", "left").where("was IS NULL OR was <> content_hash").select("file_id", "content_hash")
    return new, tags.join(new.select("file_id"), "file_id", "left_semi")


def written(stored_tags: DataFrame, stored: DataFrame, new: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored tags and hashes after `changed` has been written: those of its files are replaced, others stay. Doing so twice changes nothing."""
    rest = lambda df: df.join(new.select("file_id"), "file_id", "left_anti")
    return rest(stored_tags).unionByName(tags.select(*stored_tags.columns)), rest(stored).unionByName(new.select(*stored.columns))
