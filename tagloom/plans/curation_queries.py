"""Tag curation and the tag dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation, states
from .registry import add

T = ("tags_long",)
DICTIONARY = """
, known AS (
  SELECT DISTINCT md5(concat(rel, '|', CASE WHEN value_str IS NOT NULL THEN concat('s|', value_str) ELSE concat('n|', CAST(value_num AS VARCHAR)) END)) AS tag_id, rel, value_str, value_num
  FROM tags_long)
"""


def new_tags(t, rel: str, value: str):
    """For queries: one more tag of each file of `t`."""
    return t.select("file_id").distinct().select("file_id", F.lit(rel).alias("rel"), F.lit(value).alias("value_str"), F.lit(None).cast("double").alias("value_num"))


add("tag_dictionary", curation.dictionary, DICTIONARY + "SELECT * FROM known", T)
add(
    "tag_ids_resolved",
    lambda t: curation.resolved(t.where("rel IN ('genre', 'album')").select(F.lit("genre").alias("rel"), "value_str").distinct(), curation.dictionary(t)),
    DICTIONARY
    + """
    SELECT 'genre' AS rel, p.value_str, k.tag_id
    FROM (SELECT DISTINCT value_str FROM tags_long WHERE rel IN ('genre', 'album')) p LEFT JOIN known k ON k.rel = 'genre' AND k.value_str = p.value_str
    """,
    T,
)
add(
    "tag_by_id",
    lambda t: curation.dictionary(t).where(F.col("tag_id") == F.md5(F.lit("genre|s|ring"))),
    DICTIONARY + "SELECT * FROM known WHERE rel = 'genre' AND value_str = 'ring'",
    T,
)
add(
    "tag_renamed",
    lambda t: curation.relinked(t, "genre", ["ring"], "bolt"),
    "SELECT DISTINCT file_id, rel, CASE WHEN rel = 'genre' AND value_str = 'ring' THEN 'bolt' ELSE value_str END AS value_str, value_num FROM tags_long",
    T,
)
COUNTS = """
, own AS (SELECT DISTINCT file_id, value_str FROM tags_long WHERE rel = 'genre' AND value_str IN ({all}) {listed}),
per AS (SELECT file_id, count(*) FILTER (WHERE value_str <> '{to}') AS n, count(*) FILTER (WHERE value_str = '{to}') AS has FROM own GROUP BY file_id)
SELECT count(*) FILTER (WHERE n > 0 AND has = 0) AS moved, CAST(sum(n) - count(*) FILTER (WHERE n > 0 AND has = 0) AS BIGINT) AS skipped, CAST({gone} AS BIGINT) AS sources_removed FROM per
"""
add(
    "tag_rename_counts",
    lambda t: curation.relink_counts(t, "genre", ["ring"], "bolt"),
    COUNTS.format(all="'ring', 'bolt'", to="bolt", listed="", gone="1"),
    T,
)
add(
    "tags_merged",
    lambda t: curation.relinked(t, "genre", ["ring", "small", "large"], "bolt"),
    "SELECT DISTINCT file_id, rel, CASE WHEN rel = 'genre' AND value_str IN ('ring', 'small', 'large') THEN 'bolt' ELSE value_str END AS value_str, value_num FROM tags_long",
    T,
)
add(
    "tags_merge_counts",
    lambda t: curation.relink_counts(t, "genre", ["ring", "small"], "bolt"),
    COUNTS.format(all="'ring', 'small', 'bolt'", to="bolt", listed="", gone="2"),
    T,
)
add(
    "tag_split_files",
    lambda t, f: curation.relinked(t, "genre", ["ring"], "wedding", f.where("library_id = 1")),
    """
    SELECT DISTINCT t.file_id, rel, CASE WHEN rel = 'genre' AND value_str = 'ring' AND library_id = 1 THEN 'wedding' ELSE value_str END AS value_str, value_num
    FROM tags_long t JOIN files USING (file_id)
    """,
    ("tags_long", "files"),
)
add(
    "tag_split_counts",
    lambda t, f: curation.relink_counts(t, "genre", ["ring"], "bolt", f.where("library_id = 1")),
    """
    , own AS (SELECT DISTINCT file_id, value_str, library_id = 1 AS listed FROM tags_long JOIN files USING (file_id) WHERE rel = 'genre' AND value_str IN ('ring', 'bolt')),
    per AS (SELECT file_id, count(*) FILTER (WHERE value_str = 'ring' AND listed) AS n, count(*) FILTER (WHERE value_str = 'bolt') AS has FROM own GROUP BY file_id)
    SELECT count(*) FILTER (WHERE n > 0 AND has = 0) AS moved, CAST(sum(n) - count(*) FILTER (WHERE n > 0 AND has = 0) AS BIGINT) AS skipped,
      CAST((SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM own WHERE value_str = 'ring' AND NOT listed) AS BIGINT) AS sources_removed FROM per
    """,
    ("tags_long", "files"),
)
add(
    "tags_to_write_after_merge",
    lambda t, s: states.cleared(s, "tags_written", curation.touched(t, "genre", ["ring", "bolt"])),
    """
    , hit AS (SELECT DISTINCT file_id FROM tags_long WHERE rel = 'genre' AND value_str IN ('ring', 'bolt'))
    SELECT file_id, axis, positive AND NOT (axis = 'tags_written' AND file_id IN (SELECT file_id FROM hit)) AS positive FROM states
    """,
    ("tags_long", "states"),
)
add(
    "tags_added",
    lambda t, f: curation.added(t, new_tags(f.where("library_id = 2"), "genre", "ring")),
    "SELECT DISTINCT file_id, rel, value_str, value_num FROM tags_long UNION SELECT file_id, 'genre', 'ring', NULL FROM files WHERE library_id = 2",
    ("tags_long", "files"),
)
add(
    "tags_replaced_batch",
    lambda t, f: curation.replaced(t, new_tags(f.where("library_id = 2"), "genre", "ring").union(new_tags(f.where("library_id = 3"), "album", "none"))),
    """
    SELECT t.file_id, rel, value_str, value_num FROM tags_long t JOIN files USING (file_id)
    WHERE NOT (rel = 'genre' AND library_id = 2) AND NOT (rel = 'album' AND library_id = 3)
    UNION ALL SELECT file_id, 'genre', 'ring', NULL FROM files WHERE library_id = 2
    UNION ALL SELECT file_id, 'album', 'none', NULL FROM files WHERE library_id = 3
    """,
    ("tags_long", "files"),
)
add(
    "tags_without_files",
    lambda t, c: curation.without_files(t, c),
    "SELECT * FROM tags_long WHERE file_id NOT IN (SELECT file_id FROM claims)",
    ("tags_long", "claims"),
)
ORPHANS = (
    DICTIONARY
    + """
, used AS (SELECT DISTINCT rel, value_str, value_num FROM tags_long WHERE file_id NOT IN (SELECT file_id FROM claims)),
orphans AS (SELECT * FROM known k WHERE rel <> 'year' AND NOT EXISTS (SELECT 1 FROM used u WHERE u.rel = k.rel AND u.value_str IS NOT DISTINCT FROM k.value_str AND u.value_num IS NOT DISTINCT FROM k.value_num))
"""
)


def _orphans(t, c):
    known = curation.dictionary(t)
    # model outputs refer to the years
    return curation.orphans(known, curation.without_files(t, c), known.where("rel = 'year'"))


add("tags_orphaned", _orphans, ORPHANS + "SELECT * FROM orphans", ("tags_long", "claims"))
add("tags_orphaned_count", lambda t, c: _orphans(t, c).agg(F.count("*").alias("n_orphans")), ORPHANS + "SELECT count(*) AS n_orphans FROM orphans", ("tags_long", "claims"))
add(
    "tags_for_mode_minimal",
    lambda t: curation.for_mode(t, "minimal"),
    "SELECT * FROM tags_long WHERE starts_with(rel, 'nom:mood-')",
    T,
)
add(
    "tags_for_mode_uncalibrated",
    lambda t: curation.for_mode(t, "full", False),
    "SELECT * FROM tags_long WHERE starts_with(rel, 'nom:') AND NOT starts_with(rel, 'nom:mood-')",
    T,
)
add(
    "tags_numeric",
    lambda t: curation.numbers(t, "nom:calm"),
    "SELECT * FROM tags_long WHERE starts_with(rel, 'nom:') AND NOT starts_with(rel, 'nom:mood-') AND rel <> 'nom:calm' AND value_num IS NOT NULL",
    T,
)


def _edges(t):
    numbered = curation.dictionary(t.where("rel IN ('genre', 'album')"))
    return numbered.select("tag_id", F.col("rel").alias("output_id"), F.length("value_str").cast("double").alias("score"), F.lit(1).alias("created_at"), F.lit(1).alias("updated_at"))


add(
    "model_edges_written",
    lambda t: curation.scored_edges(_edges(t).where("score > 4"), _edges(t).where("score < 7").select("tag_id", "output_id", (F.col("score") * 2).alias("score"), F.lit(5).alias("at"))),
    DICTIONARY
    + """
    SELECT tag_id, rel AS output_id, CASE WHEN length(value_str) < 7 THEN length(value_str) * 2.0e0 ELSE length(value_str) * 1.0e0 END AS score,
      CASE WHEN length(value_str) > 4 THEN 1 ELSE 5 END AS created_at, CASE WHEN length(value_str) < 7 THEN 5 ELSE 1 END AS updated_at
    FROM known WHERE rel IN ('genre', 'album')
    """,
    T,
)
