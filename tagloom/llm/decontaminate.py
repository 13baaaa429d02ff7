"""Benchmark decontamination: a prefix-filtered join of item windows with documents, in DataFrame functions only.

Each item is cut into windows of consecutive words (an item of fewer words is
one window). A window's words are ordered by rarity in the documents; for exact
containment the necessary prefix is its rarest word, which is joined with the
places where documents have that word. Length and position bound where the
window would start, and the words there are compared in full. The items' words
are a table of their own: none of it passes through the driver, and a sieve of
bounded size keeps other words out of the joins.

Cases: a null text has no words and so no hits or windows; items without
item_id are left out; rows that share a doc_id are one document, whose text
they repeat; an empty table on either side gives no hits; further columns are
not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, sieve, text_of, words

#: Tables up to this many bytes, as JSON, and of this many rows go to every executor; beyond, Spark shuffles them.
BYTES_TO_BROADCAST = 32 << 20
ROWS_TO_BROADCAST = 200_000


def sized(df: DataFrame, most: int = ROWS_TO_BROADCAST) -> DataFrame:
    """With a broadcast hint only if it is counted to be small, in rows and in bytes."""
    n, size = df.limit(most + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if n <= most and (size or 0) <= BYTES_TO_BROADCAST else df


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """item_id and the words `w` of each window."""
    split = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words(text_of()).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    return split.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("w")).distinct()


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("h", F.xxhash64("word"))


def find_windows(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id and where item windows occur: `hits`, an array of (start, len), and `items`, of item ids; documents without any are left out."""
    kept = Kept(docs.sparkSession)
    texts = docs.select("doc_id", words(text_of()).alias("w"))
    found = windows_of(items, window)
    vocabulary = kept.write(_named(found.select(F.explode("w").alias("word")).distinct()))
    # outer explodes: else Spark would split the texts a second time to filter by size
    every = _named(texts.select(F.explode_outer("w").alias("word")).where("word is not null"))
    # counts of words are summed before they are shuffled
    seen = sieve(every, "h", vocabulary, "h").groupBy("word").agg(F.count("*").alias("n"))
    # the prefix: of each window the rarest word and its first place; a word that no document has rules the window out
    placed = found.select("item_id", "w", F.posexplode("w").alias("at", "word")).join(seen, "word", "left")
    prefix = (
        placed.groupBy("item_id", "w")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "word")).alias("p"))
        .where("p.n > 0")
        .select("item_id", F.col("w").alias("want"), F.col("p.at").alias("off"), F.col("p.word").alias("word"))
    )
    # a row a window: written once, so that words are counted once for all its uses
    prefix = kept.write(prefix)
    tokens = _named(prefix.select("word").distinct())
    places = _named(texts.select("doc_id", "w", F.posexplode_outer("w").alias("at", "word")).where("word is not null"))
    around = F.slice("w", F.greatest(F.lit(0), F.col("at") - window + 1) + 1, 2 * window - 1)
    met = sieve(places, "h", tokens, "h").select("doc_id", "at", "word", F.size("w").alias("n_words"), around.alias("around"))
    met = met.join(sized(prefix), "word").withColumn("len", F.size("want")).withColumn("start", F.col("at") - F.col("off"))
    # where the window would start among the words around the place
    inside = F.col("start") - F.greatest(F.lit(0), F.col("at") - window + 1) + 1
    fits = (F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words"))
    same = F.when(fits, F.slice("around", F.greatest(inside, F.lit(1)), F.col("len")) == F.col("want"))
    hit = met.where(same).select("doc_id", F.struct("start", "len").alias("hit"), F.col("item_id").alias("item"))
    return hit.groupBy("doc_id").agg(F.collect_set("hit").alias("hits"), F.collect_set("item").alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any occurrence), n_items, items_sha256 and contaminated."""
    found = find_windows(docs, items, window).select(F.col("doc_id").alias("of"), "hits", "items")
    every = docs.select("doc_id", F.size(words(text_of())).cast("long").alias("n_words")).groupBy("doc_id").agg(F.max("n_words").alias("n_words"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1))))
    zero = F.lit(0).cast("long")
    return every.join(found, every["doc_id"].eqNullSafe(found["of"]), "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("hits").isNotNull(), F.size(covered).cast("long")).otherwise(zero).alias("n_hit"),
        F.when(F.col("items").isNotNull(), F.size("items").cast("long")).otherwise(zero).alias("n_items"),
        F.sha2(F.coalesce(F.array_join(F.sort_array("items"), ","), F.lit("")), 256).alias("items_sha256"),
        F.col("hits").isNotNull().alias("contaminated"),
    )


def clean_only(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of `docs` without any occurrence; rows without doc_id stay."""
    found = find_windows(docs, items, window).select("doc_id")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
