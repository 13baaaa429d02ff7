"""Stored tables after changes, heads made again from tags, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curation, heads, signals, tables, tags
from .registry import ORACLE_SQL, QUERIES, add

P = ("plays",)
RULES = tags.Rules("AND", (tags.Condition("genre", "CONTAINS", "in"),), (tags.Rules("OR", (tags.Condition("nom:energy", ">", 0.95), tags.Condition("album", "=", "STANDARD"))),))
RULES_SQL = """
, hit AS (
  SELECT DISTINCT file_id FROM files WHERE file_id IN (SELECT file_id FROM tags_long WHERE rel = 'genre' AND contains(lower(value_str), 'in'))
    AND (file_id IN (SELECT file_id FROM tags_long WHERE rel = 'nom:energy' AND value_num > 0.95) OR album = 'STANDARD'))
"""
more = lambda p, by, at: p.select("user_id", "nd_id", (F.col("playcount") * by).alias("playcount"), (F.col("last_played") + F.expr(at)).alias("last_played"))

add("plays_after", lambda p: tables.plays_after(p, more(p.where("playcount > 1"), 2, "interval 1 day")), "SELECT user_id, nd_id, CASE WHEN playcount > 1 THEN playcount * 2 ELSE playcount END AS playcount, CASE WHEN playcount > 1 THEN last_played + INTERVAL 1 DAY ELSE last_played END AS last_played FROM plays", P)
add(
    "plays_rebuilt",
    lambda p: tables.plays_rebuilt(p, more(p.where("user_id % 2 = 0 AND playcount > 1"), 3, "interval 0 day")),
    """
    , again AS (SELECT DISTINCT user_id FROM plays WHERE user_id % 2 = 0 AND playcount > 1)
    SELECT user_id, nd_id, playcount, last_played FROM plays WHERE user_id NOT IN (SELECT user_id FROM again)
    UNION ALL SELECT user_id, nd_id, playcount * 3, last_played FROM plays WHERE user_id % 2 = 0 AND playcount > 1
    """,
    P,
)
add(
    "nd_links_inserted",
    lambda k, f: tables.inserted(k, f.select(F.concat(F.lit("nd"), F.col("file_id").cast("string")).alias("nd_id"), "file_id"), ["nd_id"]),
    "SELECT concat('nd', CAST(file_id AS VARCHAR)) AS nd_id, file_id FROM files",
    ("nd_links", "files"),
)
add("nd_links_cascade", lambda k, c: tables.cascade(c, "file_id", links=k)["links"], "SELECT * FROM nd_links WHERE file_id NOT IN (SELECT file_id FROM claims)", ("nd_links", "claims"))
add("folder_keys", lambda f: tables.with_folder_keys(f.select("library_id", F.col("album").alias("folder")).distinct()), "SELECT DISTINCT library_id, album AS folder, md5(concat(CAST(library_id AS VARCHAR), '/', album)) AS key FROM files", ("files",))
add("segment_keys", lambda f: f.select("file_id", tables.segment_key(F.col("file_id"), F.col("album"), F.lit("v1")).alias("key")), "SELECT file_id, sha1(concat(CAST(file_id AS VARCHAR), '|', album, '|v1')) AS key FROM files", ("files",))
add(
    "files_moved",
    lambda f: tables.moved_files(f.select("file_id", "normalized_path"), f.where("album = 'STANDARD'").select("file_id", F.concat(F.lit("new/"), "normalized_path").alias("new_path"))),
    "SELECT file_id, concat(CASE WHEN album = 'STANDARD' THEN 'new/' ELSE '' END, normalized_path) AS normalized_path FROM files",
    ("files",),
)
add(
    "claims_idle",
    lambda c: tables.idle_claims(c, c.select("worker_id", (F.col("worker_id") * 100).alias("at")).distinct(), 500),
    "SELECT * FROM claims WHERE worker_id * 100 < 500",
    ("claims",),
)
add("tag_counts_of_known", lambda t, c: tags.counts_of_known(curation.dictionary(t), curation.without_files(t, c), "genre"), "SELECT value_str, value_num, count(DISTINCT file_id) FILTER (WHERE file_id NOT IN (SELECT file_id FROM claims)) AS song_count FROM tags_long WHERE rel = 'genre' GROUP BY 1, 2", ("tags_long", "claims"))
add("rules_preview_total", lambda t, f: tags.preview(t, f, RULES, 10, 1)[0], RULES_SQL + "SELECT count(*) AS total FROM hit", ("tags_long", "files"))
add(
    "rules_preview",
    lambda t, f: tags.preview(t, f, RULES, 10, 1)[1].select("file_id", "title"),
    RULES_SQL + "SELECT file_id, title FROM files WHERE file_id IN (SELECT file_id FROM hit) ORDER BY md5(concat('1:', file_id)), file_id LIMIT 10",
    ("tags_long", "files"),
)
add("rules_nested", lambda t: tags.files_for_rules(t, RULES), RULES_SQL + "SELECT file_id FROM hit", ("tags_long",))


def _labels(g):
    """Two labels a file, with the probability of the first the mean of one score."""
    m = g.groupBy("file_id").agg(F.round(F.max("score_a") * 0.9, 4).alias("p"), F.round(F.stddev_pop("score_b") / 4, 4).alias("std"))
    return m.select("file_id", F.lit("happy").alias("label"), "p", "std").union(m.select("file_id", F.lit("non_happy"), F.round(1 - F.col("p"), 4), "std"))


LABELS = """
, m AS (SELECT file_id, round(max(score_a) * 0.9e0, 4) AS p, round(stddev_pop(score_b) / 4, 4) AS std FROM segments GROUP BY file_id),
l AS (SELECT file_id, 'happy' AS label, p, round(1 - p, 4) AS c, std FROM m UNION ALL SELECT file_id, 'non_happy', round(1 - p, 4), p, std FROM m),
d AS (SELECT *, CASE WHEN p >= 0.80 AND p / greatest(c, 1e-9) >= 1.2 AND p - c >= 0.15 AND std < 0.08 THEN 'high' WHEN p >= 0.75 AND p / greatest(c, 1e-9) >= 1.1 AND p - c >= 0.08 AND std < 0.15 THEN 'medium'
  WHEN p >= 0.60 AND p / greatest(c, 1e-9) >= 1.02 AND p - c >= 0.03 AND std < 0.25 THEN 'low' END AS tier FROM l)
"""
add("head_all_labels", lambda g: heads.decide_all(_labels(g), {"happy": 0.85}, two=True), LABELS + "SELECT file_id, label, p, CASE WHEN p >= CASE label WHEN 'happy' THEN 0.85 ELSE 0.60 END THEN tier END AS tier FROM d", ("segments",))
add("head_all_labels_named", lambda g: heads.decide_all(_labels(g), least=0.7), LABELS + "SELECT file_id, label, p, CASE WHEN p >= 0.7 THEN tier END AS tier FROM d", ("segments",))
add("head_tags", lambda g: heads.as_tags(heads.decide_all(_labels(g), two=True), "nom:"), LABELS + "SELECT file_id, concat('nom:', label) AS rel, CAST(NULL AS VARCHAR) AS value_str, p AS value_num FROM d", ("segments",))


def _states(g):
    return g.sparkSession.sql("SELECT * FROM VALUES ('mood', 'happy', 0.2D, 0.8D), ('other', 'non_happy', 0.1D, 0.9D) AS t(head_name, label, p5, p95)")


add(
    "head_reconstructed",
    lambda g: heads.reconstructed(_labels(g).select("file_id", "label", F.col("p").alias("value")), _labels(g).select("file_id", "label", "std"), _states(g), "mood").select("file_id", "label", F.round("p", 6).alias("p"), F.round("std", 6).alias("std")),
    LABELS + "SELECT file_id, label, round(CASE WHEN label = 'happy' THEN least(greatest((p - 0.2e0) / (0.8e0 - 0.2e0), 0), 1) ELSE p END, 6) AS p, round(std * CASE WHEN label = 'happy' THEN 1 / (0.8e0 - 0.2e0) ELSE 1.0e0 END, 6) AS std FROM l",
    ("segments",),
)
add(
    "signal_segments",
    lambda v: signals.segments(v.select(F.col("file_id").alias("id"), F.transform("vector", lambda x: x.cast("double")).alias("samples")), 24, 16, True).select("id", "segment", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 5).alias("total")),
    """
    , w AS (SELECT file_id AS id, segment, CAST(vector AS DOUBLE[]) AS v FROM vectors CROSS JOIN (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS segment))
    SELECT id, segment, round(coalesce(list_sum(v[segment * 16 + 1:segment * 16 + 24]), 0), 5) AS total FROM w
    """,
    ("vectors",),
)
add(
    "signal_patches",
    lambda v: signals.patches(v.select(F.col("file_id").alias("id"), F.transform("vector", lambda x: F.array(x)).alias("samples")), 24, 16).select("id", "patch", F.size("frames").alias("n")),
    "SELECT file_id AS id, patch, CAST(24 AS INTEGER) AS n FROM vectors CROSS JOIN (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS patch)",
    ("vectors",),
)


add(
    "signal_patch_contents",
    lambda v: signals.patches(v.select(F.col("file_id").alias("id"), F.transform("vector", lambda x: F.array(x)).alias("samples")), 24, 16)
    .select("id", "patch", F.posexplode("frames").alias("place", "frame")).select("id", "patch", "place", F.round(F.get("frame", F.lit(0)).cast("double"), 6).alias("value")),
    """
    SELECT file_id AS id, patch, place, CASE WHEN patch * 16 + place < 64 THEN round(CAST(vector[patch * 16 + place + 1] AS DOUBLE), 6) ELSE 0.0e0 END AS value
    FROM vectors CROSS JOIN (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS patch) CROSS JOIN (SELECT CAST(unnest(range(0, 24)) AS INTEGER) AS place)
    """,
    ("vectors",),
)


def _bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts is not null and user_id is not null")
    out = tables.settled(events.select((F.col("user_id") % 5).alias("library_id"), F.col("ts").cast("timestamp").alias("ts")), "10 minutes")
    return out.select("library_id", F.unix_millis("scan_at").alias("scan_ms"), "n_changes")


QUERIES["scan_debounced"] = _bursts
ORACLE_SQL["scan_debounced"] = """
WITH e AS (SELECT user_id % 5 AS library_id, ts FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY library_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM e),
b AS (SELECT *, sum(new) OVER (PARTITION BY library_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT library_id, epoch_us(max(ts) + INTERVAL 10 MINUTE) // 1000 AS scan_ms, count(*) AS n_changes FROM b GROUP BY library_id, burst
"""
