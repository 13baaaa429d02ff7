"""Vector search: exact top-k for given queries, and search pruned by a coarse partition. Vectors have file_id, vector and genre_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalized(vectors: DataFrame) -> DataFrame:
    """With vector_n of length 1; a zero vector stays zero."""
    length = norm(F.col("vector"))
    return vectors.withColumn("length", length).withColumn("vector_n", F.transform("vector", lambda x: F.when(F.col("length") > 0, x.cast("double") / F.col("length")).otherwise(F.lit(0.0)))).drop("length")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def search(vectors: DataFrame, seed: int, k: int, genre: int | None = None) -> DataFrame:
    """The k nearest of one file by cosine, itself left out. The seed is one row; candidates stay where they are, and k of each partition meet."""
    unit = normalized(vectors)
    one = unit.where(F.col("file_id") == seed).select(F.col("vector_n").alias("q"), F.lit(1).alias("one")).limit(1)
    rest = unit.where(F.col("file_id") != seed)
    if genre is not None:
        rest = rest.where(F.col("genre_id") == genre)
    scored = rest.withColumn("one", F.lit(1)).join(F.broadcast(one), "one").select("file_id", F.round(dot(F.col("vector_n"), F.col("q")), 6).alias("score"))
    return scored.orderBy(F.col("score").desc(), "file_id").limit(k)


def nlists(docs: Column, group: int = 15) -> Column:
    """Lists of an index: documents by group size, within 10 and 4000."""
    return F.least(F.greatest(F.floor(docs / group), F.lit(10)), F.lit(4000)).cast("long")


def nprobe(lists: Column, pct: int = 10) -> Column:
    return F.least(F.greatest(F.floor(lists * pct / 100), F.lit(1)), lists).cast("long")


def pooled(segments: DataFrame, trim: float = 0.1) -> DataFrame:
    """Of segments' vectors (file_id, vector) each file's mean by dimension, without the share `trim` of its smallest and largest values, rounded down."""
    each = segments.select("file_id", F.posexplode("vector").alias("dim", "x"))
    per = each.groupBy("file_id", "dim").agg(F.array_sort(F.collect_list(F.col("x").cast("double"))).alias("v"))
    cut = F.floor(F.size("v") * trim).cast("int")
    kept = F.slice("v", cut + 1, F.size("v") - 2 * cut)
    mean = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)
    return per.select("file_id", "dim", mean.alias("value"))


def by_tier(tiers: DataFrame) -> DataFrame:
    """Each file's vector: of the cold tier if it has one, else of the hot; of several the latest."""
    best = F.max_by(F.struct("tier", "vector"), F.struct((F.col("tier") == "cold").cast("int"), "created_at"))
    return tiers.groupBy("file_id").agg(best.alias("v")).select("file_id", "v.tier", "v.vector")


def drained(tiers: DataFrame, tags: DataFrame) -> DataFrame:
    """The cold tier after the hot one has been moved into it: a file's hot vector replaces its cold one, and all carry their genres, sorted. Draining again changes nothing."""
    best = F.max_by(F.struct("vector", "created_at"), F.struct((F.col("tier") == "hot").cast("int"), "created_at"))
    moved = tiers.groupBy("file_id").agg(best.alias("v")).select("file_id", "v.vector", "v.created_at")
    return with_genres(moved, tags)


def with_genres(vectors: DataFrame, tags: DataFrame) -> DataFrame:
    """With `genres`, each file's genre tags, sorted; empty without any."""
    genres = tags.where("rel = 'genre' AND value_str IS NOT NULL").groupBy("file_id").agg(F.array_sort(F.collect_set("value_str")).alias("genres"))
    return vectors.drop("genres").join(genres, "file_id", "left").withColumn("genres", F.coalesce("genres", F.array().cast("array<string>")))


def tier_stats(tiers: DataFrame) -> DataFrame:
    """One row: vectors in either tier, and whether the hot one is empty."""
    hot = F.count_if(F.col("tier") == "hot")
    return tiers.agg(hot.alias("hot_count"), F.count_if(F.col("tier") == "cold").alias("cold_count"), (hot == 0).alias("hot_empty"))


def search_params(docs: Column, group: int = 15, pct: int = 10) -> list[Column]:
    """What a search of so many documents looks at: groups, groups probed, songs checked and their share in per cent."""
    lists = nlists(docs, group)
    probes = nprobe(lists, pct)
    songs = F.least(docs, F.ceil(docs * probes / lists)).cast("long")
    return [lists.alias("groups"), probes.alias("probed"), songs.alias("songs_checked"), F.when(docs > 0, F.round(100.0 * songs / docs, 1)).otherwise(0.0).alias("pct")]


def across_libraries(vectors: DataFrame, files: DataFrame, seed: int, k: int, min_score: float = 0.0, libraries: list[int] | None = None) -> DataFrame:
    """The k nearest of a file over the k nearest of each library, without it, of at least `min_score`; a file of several libraries counts once, by its best score.

    The score is checked after the k of each library are taken. Ranks within a
    library are pruned before the shuffle.
    """
    unit = normalized(vectors)
    one = unit.where(F.col("file_id") == seed).select(F.col("vector_n").alias("q")).limit(1)
    own = files.select("file_id", "library_id")
    if libraries is not None:
        own = own.where(F.col("library_id").isin(libraries))
    scored = unit.where(F.col("file_id") != seed).join(own, "file_id").crossJoin(F.broadcast(one)).select("library_id", "file_id", F.round(dot(F.col("vector_n"), F.col("q")), 6).alias("score"))
    w = Window.partitionBy("library_id").orderBy(F.col("score").desc(), "file_id")
    best = scored.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)
    merged = best.groupBy("file_id").agg(F.max("score").alias("score")).where(F.col("score") >= min_score)
    return merged.orderBy(F.col("score").desc(), "file_id").limit(k)


def similar_tracks(vectors: DataFrame, links: DataFrame, files: DataFrame, seed: str, n: int) -> DataFrame:
    """The first n of the 2 n + 1 tracks nearest to a track (nd_id) that have an nd_id of their own, with title and artist."""
    one = links.where(F.col("nd_id") == seed).select("file_id").limit(1)
    unit = normalized(vectors)
    q = unit.join(F.broadcast(one), "file_id").select(F.col("vector_n").alias("q"), F.col("file_id").alias("seed"))
    scored = unit.crossJoin(F.broadcast(q)).select("file_id", "seed", F.round(dot(F.col("vector_n"), F.col("q")), 6).alias("score"))
    near = scored.orderBy(F.col("score").desc(), "file_id").limit(2 * n + 1).where("file_id <> seed")
    named = near.join(links.groupBy("file_id").agg(F.max("nd_id").alias("nd_id")), "file_id").join(files.select("file_id", "title", "artist"), "file_id", "left")
    return named.orderBy(F.col("score").desc(), "file_id").limit(n).select("nd_id", "file_id", "title", "artist", "score")


#: Vectors that lists are fitted on, at most; every vector is put into a list.
MAX_FIT = 100_000


class Ivf:
    """An index of so many lists over vectors, below a new shared folder: `vector_index` for a table that does not change."""

    def __init__(self, vectors: DataFrame, lists: int):
        from .vector_index import VectorIndex

        self.index = VectorIndex(vectors.sparkSession)
        self.index.build(vectors, lists=lists)

    def search(self, seed: int, k: int, probes: int) -> DataFrame:
        """The k nearest of a file among the `probes` lists whose centres are nearest to it; none if it is not in the index."""
        query = self.index.vector_of(seed)
        return self.index.search(query or [], k, probes if query else 0, without=seed)
