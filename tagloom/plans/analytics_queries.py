"""Figures of tags, moods, artists and heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as an
from ..operators import library, scores
from .registry import add

T, ME = ("tags_long",), ("mood_edges",)
TYPES = """
, vals AS (SELECT rel, value_str, value_num, count(*) AS edges FROM tags_long GROUP BY 1, 2, 3),
per AS (SELECT rel, count(*) AS n, count(value_num) AS nums, min(value_num) AS lo, max(value_num) AS hi, CAST(sum(edges) AS BIGINT) AS total_count FROM vals GROUP BY rel),
types AS (
  SELECT rel, CASE WHEN nums > n / 2.0e0 THEN 'float' ELSE 'string' END AS type, n > 1 AS is_multivalue,
    CASE WHEN nums > n / 2.0e0 THEN concat('min=', CAST(lo AS VARCHAR), ', max=', CAST(hi AS VARCHAR), ', unique=', CAST(nums AS VARCHAR)) ELSE concat('unique=', CAST(n AS VARCHAR)) END AS summary, total_count
  FROM per)
"""
add("tag_stats_all", an.type_stats, TYPES + "SELECT * FROM types", T)
add(
    "tag_stats_preview",
    an.preview,
    TYPES + "SELECT *, concat('nom-', substr(rel, 5)) AS short_name, replace(concat('nom-', substr(rel, 5)), '-', '_') AS field, false AS versioned FROM types WHERE starts_with(rel, 'nom:')",
    T,
)
add(
    "tag_frequencies",
    lambda t: an.frequencies(t, "nom:mood-", 15),
    """
    , k AS (
      SELECT CASE WHEN rel = 'genre' THEN 'genre' ELSE 'own' END AS kind, CASE WHEN rel = 'genre' THEN value_str ELSE concat(substr(rel, 10), ':', value_str) END AS name, count(DISTINCT file_id) AS song_count
      FROM tags_long WHERE rel = 'genre' OR starts_with(rel, 'nom:mood-') GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY song_count DESC, name) AS nth FROM k)
    SELECT kind, name, song_count FROM r WHERE nth <= 15
    """,
    T,
)
add(
    "mood_distribution",
    an.mood_distribution,
    """
    , c AS (SELECT substr(rel, 5) AS tier, value_str AS mood, count(*) AS n FROM mood_edges GROUP BY 1, 2 UNION ALL SELECT 'all', value_str, count(*) FROM mood_edges GROUP BY 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY n DESC, mood) AS nth FROM c),
    k AS (SELECT * FROM r WHERE nth <= CASE WHEN tier = 'all' THEN 30 ELSE 20 END)
    SELECT tier, mood, n, round(100.0e0 * n / sum(n) OVER (PARTITION BY tier), 2) AS pct FROM k
    """,
    ME,
)
add("mood_rows", lambda e: e.select(F.substring("rel", 5, 100).alias("tier"), "value_str"), "SELECT substr(rel, 5) AS tier, value_str FROM mood_edges", ME)
TOP = """
, own AS (SELECT DISTINCT file_id, value_str AS mood FROM mood_edges),
top AS (SELECT mood, count(*) AS m FROM own GROUP BY mood ORDER BY m DESC, mood LIMIT 4)
"""
add(
    "mood_correlation_top",
    lambda e: an.top_correlation(e, 4, 2),
    TOP
    + """
    , c AS (SELECT a.mood, b.mood AS other, round((SELECT count(*) FROM own x JOIN own y USING (file_id) WHERE x.mood = a.mood AND y.mood = b.mood) / CAST(a.m AS DOUBLE), 3) AS p FROM top a, top b WHERE a.mood <> b.mood),
    r AS (SELECT *, row_number() OVER (PARTITION BY mood ORDER BY p DESC, other) AS nth FROM c)
    SELECT mood, other, p FROM r WHERE nth <= 2
    """,
    ME,
)
add(
    "mood_tier_correlation",
    lambda e, f: an.tier_correlation(e, f.select("file_id", F.lit("nom:album_tier").alias("rel"), F.lower("album").alias("value_str")), 4),
    TOP
    + """
    , c AS (SELECT o.mood, concat(lower(album), '_album') AS other, round(count(*) / CAST(any_value(m) AS DOUBLE), 3) AS p FROM own o JOIN top t ON t.mood = o.mood JOIN files f ON f.file_id = o.file_id GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY mood ORDER BY p DESC, other) AS nth FROM c)
    SELECT mood, other, p FROM r WHERE nth <= 10
    """,
    ("mood_edges", "files"),
)
add(
    "artist_profile",
    lambda t: an.artist_profile(t, "Brand#13"),
    """
    , songs AS (SELECT DISTINCT file_id FROM tags_long WHERE rel = 'artist' AND value_str = 'Brand#13'),
    own AS (SELECT substr(rel, 5) AS name, value_str, value_num FROM tags_long WHERE starts_with(rel, 'nom:') AND file_id IN (SELECT file_id FROM songs)),
    c AS (SELECT CASE WHEN starts_with(name, 'mood-') THEN 'mood' ELSE 'tag' END AS kind, CASE WHEN starts_with(name, 'mood-') THEN value_str ELSE name END AS name, count(*) AS n, round(coalesce(avg(value_num), 0), 4) AS average FROM own GROUP BY 1, 2)
    SELECT * FROM c UNION ALL SELECT 'files', 'Brand#13', (SELECT count(*) FROM songs), round((SELECT count(*) FROM own WHERE NOT starts_with(name, 'mood-')) / CAST((SELECT count(*) FROM songs) AS DOUBLE), 4)
    """,
    T,
)
add("files_with_namespace", lambda t: an.files_with(t, "nom:mood-"), "SELECT count(DISTINCT file_id) AS n_files FROM tags_long WHERE starts_with(rel, 'nom:mood-')", T)
add("mood_first_values", lambda t: an.first_values(t, "nom:mood-loose", 40), "SELECT DISTINCT value_str FROM (SELECT value_str FROM tags_long WHERE rel = 'nom:mood-loose' ORDER BY value_str LIMIT 40)", T)
add("tags_count_search", lambda t: t.where("rel = 'genre'").where(F.lower("value_str").contains("in")).select("value_str").distinct().agg(F.count("*").alias("n")), "SELECT count(DISTINCT value_str) AS n FROM tags_long WHERE rel = 'genre' AND contains(lower(value_str), 'in')", T)


def _head_stats(g):
    of = lambda c: scores.segment_stats(g, c).select("file_id", "n", F.struct(F.lit(c).alias("label"), "mean", "std", F.col("least").alias("min"), F.col("largest").alias("max")).alias(c))
    return of("score_a").join(of("score_b").drop("n"), "file_id").select("file_id", "n", F.array("score_a", "score_b").alias("label_stats"))


add(
    "stats_summary",
    lambda g: an.head_summary(_head_stats(g)),
    """
    , s AS (SELECT file_id, count(*) AS n, round(stddev_pop(score_a), 6) AS a, round(stddev_pop(score_b), 6) AS b FROM segments GROUP BY 1)
    SELECT count(*) AS file_count, round(sum(a + b) / (2 * count(*)), 6) AS avg_std, min(n) AS min_segments, max(n) AS max_segments FROM s
    """,
    ("segments",),
)
add(
    "high_variance_of_label",
    lambda g: an.unsteady(_head_stats(g), "score_b", 0.33),
    """
    SELECT file_id, 'score_b' AS label, round(avg(score_b), 6) AS mean, round(stddev_pop(score_b), 6) AS std, min(score_b) AS min, max(score_b) AS max FROM segments
    GROUP BY 1 HAVING round(stddev_pop(score_b), 6) > 0.33
    """,
    ("segments",),
)
add(
    "collection_overview",
    lambda f, t: library.overview(f).crossJoin(t.where("rel = 'year'").agg(F.countDistinct("value_num").alias("years"))).crossJoin(t.where("rel = 'genre'").agg(F.countDistinct("value_str").alias("genres"))).select("n_files", "artists", "albums", "total_size", "years", "genres"),
    """
    SELECT count(*) AS n_files, count(DISTINCT artist) AS artists, count(DISTINCT album) AS albums, CAST(sum(file_size) AS BIGINT) AS total_size,
      (SELECT count(DISTINCT value_num) FROM tags_long WHERE rel = 'year') AS years, (SELECT count(DISTINCT value_str) FROM tags_long WHERE rel = 'genre') AS genres FROM files
    """,
    ("files", "tags_long"),
)
