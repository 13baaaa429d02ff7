"""Quality rules with verdicts for hosts, in DataFrame functions only.

Each text is held against rules; failures are aggregated by host, whose rate is
shrunk by a beta prior that is fitted to all hosts' rates by moments; a host's
verdict is joined back to its texts.

Cases: a null text counts as one without words; it fails the rules, as an empty
one does; a null host is one of its own; repeated rows come out repeated (and
count so); an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Kept, split_words, text_of

MIN_WORDS = 50
REPEATED_PERCENT = 50
#: The method's own rules on a text, in percent of its words or lines.
SYMBOLS_PERCENT = 25
DUP_LINES_PERCENT = 60
#: A host fails at this shrunk rate of failures, or beyond.
HOST_RATE = 0.6


def repeated_words(w: Column) -> Column:
    """How many words lie in windows of three words that the text holds twice or more; `w` is a column of words.

    Windows are sorted by hash and words, equal ones then stand together, and
    the places of those that have a neighbour are united.
    """
    n = F.size(w)
    windows = F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    return windows


def features(docs: DataFrame, host: str = "source") -> DataFrame:
    text = text_of()
    first = docs.select("doc_id", F.col(host).cast("string").alias("host"), text.alias("t"), split_words(text, SPACES).alias("w"))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    second = first.select("doc_id", "host", "t", "w", lines.alias("lines"), repeated_words(F.col("w")).alias("s"))
    # neighbours are met by shifting the array, never by an index, so that the work stays linear
    follows = F.zip_with("s", F.slice("s", 2, F.greatest(F.lit(1), F.size("s"))), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))
    third = second.select("*", follows.alias("follows"))
    twice = F.zip_with("follows", F.concat(F.array(F.lit(False)), "follows"), lambda x, y: F.coalesce(x, F.lit(False)) | y)
    starts = F.sort_array(F.array_compact(F.zip_with("s", twice, lambda x, y: F.when(y, x["i"]))))
    third = third.select("doc_id", "host", "t", "w", "lines", starts.alias("p"))
    # the union of [p, p + 3): each start adds up to three words
    gaps = F.zip_with("p", F.slice("p", 2, F.greatest(F.lit(1), F.size("p"))), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
    added = F.aggregate(gaps, F.lit(0), lambda a, x: a + x)
    return third.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        added.cast("long").alias("n_repeat_words"),
    )


def host_rates(f: DataFrame) -> DataFrame:
    """Each host's number of texts and failures, and the rate shrunk by the beta prior (method of moments).

    One row for the whole table holds the prior's moments: a global aggregate,
    which Spark pre-aggregates.
    """
    hosts = f.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failures"))
    rate = F.col("failures") / F.col("n")
    m = hosts.agg(F.avg(rate).alias("mean"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("var"))
    spread = F.col("mean") * (1 - F.col("mean"))
    # pseudo-counts; equal rates say nothing of the spread: a prior as of two texts
    size = F.when((F.col("var") > 0) & (F.col("var") < spread), spread / F.col("var") - 1).otherwise(F.lit(2.0))
    prior = m.select((F.col("mean") * size).alias("alpha"), ((1 - F.col("mean")) * size).alias("beta"), F.lit(1).alias("one"))
    joined = hosts.withColumn("one", F.lit(1)).join(F.broadcast(prior), "one")
    return joined.select("host", "n", "failures", ((F.col("failures") + F.col("alpha")) / (F.col("n") + F.col("alpha") + F.col("beta"))).alias("host_rate"))


def quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """The counts of each text, base_failed, the host's shrunk rate, and kept."""
    kept = Kept(docs.sparkSession)
    f = features(docs, host)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    own = (100 * F.col("n_symbols") > SYMBOLS_PERCENT * F.col("word_chars")) | (100 * F.col("n_dup_lines") > DUP_LINES_PERCENT * F.col("n_lines"))
    # counts are a few numbers a text: written once, read for the hosts and for the verdicts
    f = kept.write(f.withColumn("base_failed", base).withColumn("failed", base | F.coalesce(own, F.lit(False))))
    rates = host_rates(f).select(F.col("host").alias("h"), "host_rate")
    out = f.join(rates, f.host.eqNullSafe(rates.h), "left")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("failed") & (F.col("host_rate") < HOST_RATE)).alias("kept"),
        F.col("failed").alias("rule_failed"), F.round("host_rate", 9).alias("host_rate"),
    )
