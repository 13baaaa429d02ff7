"""Selections and updates of stored tables, moods of a library, plays with their files, addresses and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..functions.playlist_urls import playlist_of
from ..operators import calibration, files, moods, personal, scores
from ..operators import vectors as vx
from .registry import add

MF = ("mood_edges", "files")

add("library_paths", lambda f: f.select("library_id", "normalized_path"), "SELECT library_id, normalized_path FROM files", ("files",))
add(
    "folder_paths",
    lambda f: f.where("library_id = 2").select(files.parent(F.col("normalized_path")).alias("folder")).distinct(),
    "SELECT DISTINCT regexp_replace(normalized_path, '/?[^/]*$', '') AS folder FROM files WHERE library_id = 2",
    ("files",),
)
add("track_keys", lambda k: k.select("nd_id").distinct(), "SELECT DISTINCT nd_id FROM nd_links", ("nd_links",))
add(
    "head_stats",
    lambda g: scores.segment_stats(g, "score_b").withColumn("head_name", F.lit("calm-head")).where("head_name = 'calm-head'"),
    "SELECT file_id, count(score_b) AS n, round(avg(score_b), 6) AS mean, round(stddev_pop(score_b), 6) AS std, min(score_b) AS least, max(score_b) AS largest, 'calm-head' AS head_name FROM segments GROUP BY file_id",
    ("segments",),
)
add(
    "folders_after_missing",
    # folders of which the files that are claimed are all that is left on the disk
    lambda f, c: files.without(f.select("library_id", "album").distinct(), f.select("library_id", "album").distinct().join(f.join(c.select("file_id"), "file_id", "left_semi").select("library_id", "album").distinct(), ["library_id", "album"], "left_anti").select("album"), "album"),
    """
    , there AS (SELECT DISTINCT library_id, album FROM files WHERE file_id IN (SELECT file_id FROM claims)),
    gone AS (SELECT DISTINCT album FROM files f WHERE NOT EXISTS (SELECT 1 FROM there t WHERE t.library_id = f.library_id AND t.album = f.album))
    SELECT DISTINCT library_id, album FROM files WHERE album NOT IN (SELECT album FROM gone)
    """,
    ("files", "claims"),
)
add(
    "vector_upserted",
    # each file's vector of the model suite: the new one where there is one
    lambda t: vx.normalized(t.groupBy("file_id").agg(F.max_by("vector", F.struct("created_at", "tier")).alias("vector"), F.max("created_at").alias("created_at"))).select("file_id", "created_at", F.round(F.get("vector_n", F.lit(0)), 6).alias("x0"), F.size("vector").alias("embed_dim")),
    """
    , one AS (SELECT file_id, max(created_at) AS created_at, any_value(CAST(vector AS DOUBLE[])) AS v FROM tiers GROUP BY file_id)
    SELECT file_id, created_at, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS x0, CAST(len(v) AS INTEGER) AS embed_dim FROM one
    """,
    ("tiers",),
)
_STATE = ["p5", "p95", "n"]
add(
    "calibration_upserted",
    lambda s: files.upserted(calibration.latest(s).where("calibration_key < 'head5'").select("calibration_key", *_STATE), calibration.latest(s).where("calibration_key > 'head3'").select("calibration_key", (F.col("p5") * 2).alias("p5"), F.lit(None).cast("double").alias("p95"), "n"), ["calibration_key"], _STATE),
    """
    , r AS (SELECT *, row_number() OVER (PARTITION BY calibration_key ORDER BY snapshot_at DESC) AS nth FROM snapshots)
    SELECT calibration_key, CASE WHEN calibration_key > 'head3' THEN p5 * 2 ELSE p5 END AS p5, CASE WHEN calibration_key < 'head5' THEN p95 END AS p95, n FROM r WHERE nth = 1 AND (calibration_key < 'head5' OR calibration_key > 'head3')
    """,
    ("snapshots",),
)
add(
    "calib_compared",
    # figures of two calibrations, as far apart as their keys say
    lambda s: calibration.compared(calibration.latest(s).select("calibration_key", *(F.round(F.col(c) * k, 6).alias(m) for m, c, k in (("apd_p5", "p5", 0.05), ("apd_p95", "p95", 0.02), ("srd", "p95", 0.2), ("jsd", "p5", 0.5), ("median_drift", "p5", 0.3), ("iqr_drift", "p95", 0.1))))).select("calibration_key", "failed_metrics", "is_stable"),
    """
    , r AS (SELECT *, row_number() OVER (PARTITION BY calibration_key ORDER BY snapshot_at DESC) AS nth FROM snapshots),
    m AS (SELECT calibration_key, round(p5 * 0.05e0, 6) > 0.01 AS a, round(p95 * 0.02e0, 6) > 0.01 AS b, round(p95 * 0.2e0, 6) > 0.05 AS c, round(p5 * 0.5e0, 6) > 0.1 AS d, round(p5 * 0.3e0, 6) > 0.05 AS e, round(p95 * 0.1e0, 6) > 0.1 AS f FROM r WHERE nth = 1)
    SELECT calibration_key, concat_ws(',', CASE WHEN a THEN 'apd_p5' END, CASE WHEN b THEN 'apd_p95' END, CASE WHEN c THEN 'srd' END, CASE WHEN d THEN 'jsd' END, CASE WHEN e THEN 'median_drift' END, CASE WHEN f THEN 'iqr_drift' END) AS failed_metrics,
      NOT (a OR b OR c OR d OR e OR f) AS is_stable FROM m
    """,
    ("snapshots",),
)

# moods of a library
for _tier, _in in (("strict", "'nom:mood-strict'"), ("loose", "'nom:mood-strict', 'nom:mood-regular', 'nom:mood-loose'")):
    add(
        f"mood_top_pairs_{_tier}",
        (lambda tier: lambda e, f: moods.analysis(e, f, tier, 3, 1)["top_pairs"])(_tier),
        f"""
        , m AS (SELECT DISTINCT file_id, value_str FROM mood_edges WHERE rel IN ({_in}) AND file_id IN (SELECT file_id FROM files WHERE library_id = 1))
        SELECT a.value_str AS mood1, b.value_str AS mood2, count(*) AS n_files FROM m a JOIN m b ON a.file_id = b.file_id AND a.value_str < b.value_str GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 3
        """,
        MF,
    )
add(
    "mood_balance_library",
    lambda e, f: moods.analysis(e, f, library=2)["balance"],
    "SELECT rel, value_str AS mood, count(*) AS n FROM mood_edges WHERE file_id IN (SELECT file_id FROM files WHERE library_id = 2) GROUP BY 1, 2",
    MF,
)
add(
    "mood_coverage_library",
    lambda e, f: moods.analysis(e, f, library=2)["coverage"],
    """
    SELECT rel, count(DISTINCT file_id) AS tagged, round(100.0e0 * count(DISTINCT file_id) / (SELECT count(*) FROM files WHERE library_id = 2), 1) AS pct
    FROM mood_edges WHERE file_id IN (SELECT file_id FROM files WHERE library_id = 2) GROUP BY 1
    """,
    MF,
)
add(
    "files_of_moods",
    lambda e: moods.files_of_moods(e, e.sparkSession.sql("SELECT * FROM VALUES ('strict', '1-URGENT'), ('regular', '1-URGENT'), ('loose', '5-LOW'), ('other', '5-LOW') AS t(tier, mood)")),
    """
    , s(tier, mood, l) AS (VALUES ('strict', '1-URGENT', 0), ('regular', '1-URGENT', 1), ('loose', '5-LOW', 2)),
    e AS (SELECT file_id, value_str, CASE rel WHEN 'nom:mood-strict' THEN 0 WHEN 'nom:mood-regular' THEN 1 ELSE 2 END AS l FROM mood_edges)
    SELECT DISTINCT tier, mood, file_id FROM s JOIN e ON e.value_str = mood AND e.l <= s.l
    """,
    ("mood_edges",),
)
add(
    "plays_top_files",
    lambda p, k, f: personal.with_files(personal.top_tracks(p, 3).withColumn("nd_id", F.concat(F.lit("nd"), "nd_id")), k, f),
    """
    , t AS (SELECT user_id, concat('nd', nd_id) AS nd_id, playcount, row_number() OVER (PARTITION BY user_id ORDER BY playcount DESC, last_played DESC, nd_id) AS rank FROM plays)
    SELECT user_id, t.nd_id, playcount, rank, f.file_id, title, artist FROM t LEFT JOIN nd_links k ON k.nd_id = t.nd_id LEFT JOIN files f ON f.file_id = k.file_id WHERE rank <= 3
    """,
    ("plays", "nd_links", "files"),
)

# addresses and names
def _url_of():
    """An address of each form."""
    id_ = F.concat(F.lit("9"), "file_id")
    forms = (("https://open.spotify.com/playlist/", "x?si=1"), ("spotify:playlist:", "x"), (" http://www.deezer.com/fr/playlist/", "/x"), ("deezer.com/playlist/", "abc"), ("https://link.deezer.com/s/", ""), ("https://example.com/playlist/", ""))
    return F.element_at(F.array(*(F.concat(F.lit(a), id_, F.lit(b)) for a, b in forms)), (F.col("file_id") % 6 + 1).cast("int"))


add(
    "playlist_urls",
    lambda f: f.select("file_id", playlist_of(_url_of()).alias("p")).select("file_id", "p.platform", "p.playlist_id", "p.is_short_link"),
    """
    SELECT file_id, CASE WHEN file_id % 6 < 2 THEN 'spotify' WHEN file_id % 6 < 5 THEN 'deezer' END AS platform,
      CASE WHEN file_id % 6 < 2 THEN concat('9', file_id, 'x') WHEN file_id % 6 < 4 THEN concat('9', file_id) WHEN file_id % 6 = 4 THEN '' END AS playlist_id,
      CASE WHEN file_id % 6 < 4 THEN false WHEN file_id % 6 = 4 THEN true END AS is_short_link
    FROM files
    """,
    ("files",),
)


add(
    "albums_comparable",
    lambda f: f.select("file_id", texts.comparable_album(F.concat("album", F.lit(" (Remastered) Disc 2"))).alias("a"), texts.comparable_album(F.concat(F.upper("album"), F.lit(" CD1"))).alias("b")),
    "SELECT file_id, concat(lower(album), ' remastered') AS a, lower(album) AS b FROM files",
    ("files",),
)
add(
    "track_numbers",
    lambda f: f.select("file_id", texts.n_of_total(F.col("file_id") % 20, F.when(F.col("library_id") > 1, F.col("library_id") * 10)).alias("track")),
    "SELECT file_id, CASE WHEN library_id > 1 THEN concat(file_id % 20, '/', library_id * 10) ELSE CAST(file_id % 20 AS VARCHAR) END AS track FROM files",
    ("files",),
)
