"""Vectors: tiers, search over libraries, similar tracks, an index of lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors as vx
from ..operators.vector_index import VectorIndex
from .registry import add

UNIT = ", unit AS (SELECT file_id, CAST(vector AS DOUBLE[]) AS v FROM vectors)"
SCORE = "round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)), 6)"
first = lambda c: F.round(F.get(c, F.lit(0)).cast("double"), 6)

add(
    "vector_by_tier",
    lambda t: vx.by_tier(t).select("file_id", "tier", first("vector").alias("x0"), F.size("vector").alias("dim")),
    """
    , r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY tier, created_at DESC) AS nth FROM tiers)
    SELECT file_id, tier, round(CAST(vector[1] AS DOUBLE), 6) AS x0, CAST(len(vector) AS INTEGER) AS dim FROM r WHERE nth = 1
    """,
    ("tiers",),
)
add(
    "vectors_of_files",
    lambda v, f: v.join(f.where("library_id = 1"), "file_id", "left_semi").select("file_id", first("vector").alias("x0")),
    "SELECT file_id, round(CAST(vector[1] AS DOUBLE), 6) AS x0 FROM vectors WHERE file_id IN (SELECT file_id FROM files WHERE library_id = 1)",
    ("vectors", "files"),
)
add(
    "hot_cold_drain",
    lambda t, g: vx.drained(t, g).select("file_id", "created_at", F.array_join("genres", ",").alias("genres")),
    """
    , g AS (SELECT file_id, string_agg(DISTINCT value_str, ',' ORDER BY value_str) AS genres FROM tags_long WHERE rel = 'genre' GROUP BY file_id)
    SELECT t.file_id, max(created_at) AS created_at, max(coalesce(genres, '')) AS genres FROM tiers t LEFT JOIN g ON g.file_id = t.file_id GROUP BY t.file_id
    """,
    ("tiers", "tags_long"),
)
add(
    "hot_cold_stats",
    vx.tier_stats,
    "SELECT count(*) FILTER (WHERE tier = 'hot') AS hot_count, count(*) FILTER (WHERE tier = 'cold') AS cold_count, count(*) FILTER (WHERE tier = 'hot') = 0 AS hot_empty FROM tiers",
    ("tiers",),
)
add(
    "promotion_nlists",
    lambda t: t.agg(F.countDistinct("file_id").alias("docs")).select("docs", *vx.search_params(F.col("docs"))),
    """
    , d AS (SELECT count(DISTINCT file_id) AS docs FROM tiers),
    n AS (SELECT docs, CAST(least(greatest(docs // 15, 10), 4000) AS BIGINT) AS groups FROM d),
    p AS (SELECT *, CAST(least(greatest(groups * 10 // 100, 1), groups) AS BIGINT) AS probed FROM n)
    SELECT docs, groups, probed, CAST(least(docs, ceil(docs * probed / groups)) AS BIGINT) AS songs_checked, round(100.0e0 * least(docs, ceil(docs * probed / groups)) / docs, 1) AS pct FROM p
    """,
    ("tiers",),
)
add(
    "vector_fanout",
    lambda v, f: vx.across_libraries(v, f, 7, 10, 0.05),
    UNIT
    + f"""
    , s AS (SELECT library_id, b.file_id, {SCORE} AS score FROM unit a, unit b JOIN files f ON f.file_id = b.file_id WHERE a.file_id = 7 AND b.file_id <> 7),
    r AS (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY score DESC, file_id) AS nth FROM s)
    SELECT file_id, score FROM r WHERE nth <= 10 AND score >= 0.05 ORDER BY score DESC, file_id LIMIT 10
    """,
    ("vectors", "files"),
)
add(
    "vector_search_library",
    lambda v, f: vx.across_libraries(v, f, 7, 10, libraries=[3]),
    UNIT + f"SELECT b.file_id, {SCORE} AS score FROM unit a, unit b JOIN files f ON f.file_id = b.file_id WHERE a.file_id = 7 AND library_id = 3 ORDER BY score DESC, b.file_id LIMIT 10",
    ("vectors", "files"),
)
add(
    "similar_tracks",
    lambda v, k, f: vx.similar_tracks(v, k, f, "nd4", 10),
    UNIT
    + f"""
    , s AS (SELECT b.file_id, {SCORE} AS score FROM unit a, unit b WHERE a.file_id = (SELECT file_id FROM nd_links WHERE nd_id = 'nd4')),
    r AS (SELECT * FROM s ORDER BY score DESC, file_id LIMIT 21)
    SELECT nd_id, r.file_id, title, artist, score FROM r JOIN nd_links USING (file_id) JOIN files f ON f.file_id = r.file_id WHERE nd_id <> 'nd4' ORDER BY score DESC, r.file_id LIMIT 10
    """,
    ("vectors", "nd_links", "files"),
)
add(
    "vector_pooled",
    lambda v, f: vx.pooled(v.join(f, "file_id").select(F.col("library_id").alias("file_id"), "vector")).withColumn("value", F.round("value", 5) + 0.0),
    """
    , e AS (SELECT library_id AS file_id, CAST(vector[i] AS DOUBLE) AS x, i - 1 AS dim FROM vectors JOIN files USING (file_id) CROSS JOIN (SELECT CAST(unnest(range(1, 65)) AS INTEGER) AS i)),
    r AS (SELECT *, row_number() OVER (PARTITION BY file_id, dim ORDER BY x) AS nth, count(*) OVER (PARTITION BY file_id, dim) AS n FROM e)
    SELECT file_id, dim, round(avg(x), 5) + 0.0e0 AS value FROM r WHERE nth > floor(n * 0.1e0) AND nth <= n - floor(n * 0.1e0) GROUP BY file_id, dim
    """,
    ("vectors", "files"),
)
# approximate by nature; tests measure its recall
add("vector_ivf", lambda v: vx.Ivf(v, 20).search(7, 10, 8), views=("vectors",))

#: More cells than there can be: all of them are probed, and the result is exact.
ALL = 4001


def _searched(index, genre=None):
    return index.search(index.vector_of(7), 10, ALL, genre=genre, without=7)


def _built(v, tags=None):
    index = VectorIndex(v.sparkSession)
    index.build(v, tags)
    return index


def _promoted(t, tags=None):
    """The cold tier's index after the hot tier, of which each vector is turned round, has been moved in."""
    index = _built(t.where("tier = 'cold'"), tags)
    index.promote(t.where("tier = 'hot'").withColumn("vector", F.reverse("vector")), tags)
    return index


GENRES = ", g AS (SELECT file_id FROM tags_long WHERE rel = 'genre' AND value_str = (SELECT min(value_str) FROM tags_long WHERE rel = 'genre'))"
DRAINED = """
, m AS (
  SELECT file_id, CASE WHEN max(tier) = 'hot' THEN list_reverse(any_value(CAST(vector AS DOUBLE[]))) ELSE any_value(CAST(vector AS DOUBLE[])) END AS v FROM tiers GROUP BY file_id)
"""
add(
    "vector_ivf_stored",
    lambda v: _searched(_built(v)),
    UNIT + f"SELECT b.file_id, {SCORE} AS score FROM unit a, unit b WHERE a.file_id = 7 AND b.file_id <> 7 ORDER BY score DESC, b.file_id LIMIT 10",
    ("vectors",),
)
add(
    "vector_ivf_genre",
    lambda v, t: _searched(_built(v, t), t.where("rel = 'genre'").agg(F.min("value_str")).first()[0]),
    UNIT + GENRES + f"SELECT b.file_id, {SCORE} AS score FROM unit a, unit b WHERE a.file_id = 7 AND b.file_id <> 7 AND b.file_id IN (FROM g) ORDER BY score DESC, b.file_id LIMIT 10",
    ("vectors", "tags_long"),
)
add(
    "vector_promoted",
    lambda t: _searched(_promoted(t)),
    DRAINED + f"SELECT b.file_id, {SCORE} AS score FROM m a, m b WHERE a.file_id = 7 AND b.file_id <> 7 ORDER BY score DESC, b.file_id LIMIT 10",
    ("tiers",),
)
add(
    "vector_promoted_rows",
    lambda t, g: _promoted(t, g).rows().select("file_id", "created_at", F.array_join("genres", ",").alias("genres"), first("vector").alias("x0")),
    DRAINED
    + """
    , g AS (SELECT file_id, string_agg(DISTINCT value_str, ',' ORDER BY value_str) AS genres FROM tags_long WHERE rel = 'genre' GROUP BY file_id)
    SELECT t.file_id, max(created_at) AS created_at, max(coalesce(genres, '')) AS genres, round(any_value(m.v)[1], 6) AS x0
    FROM tiers t JOIN m ON m.file_id = t.file_id LEFT JOIN g ON g.file_id = t.file_id GROUP BY t.file_id
    """,
    ("tiers", "tags_long"),
)
