"""Workflows as one plan: scans, syncs with a player, documents, pooling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import playlists, scans, scores, sync
from ..operators.files import parent
from .registry import add

# a scan: of four files one is as it was, one has changed, one moved, and one went while another came
def _kind():
    return F.col("file_id") % 4


def _new_path():
    return F.when(_kind() == 2, F.concat(F.lit("moved/"), "normalized_path")).when(_kind() == 3, F.concat("normalized_path", F.lit(".flac"))).otherwise(F.col("normalized_path"))


def _known(f):
    return f.select("file_id", "normalized_path", "file_size", F.lit(1000).cast("long").alias("modified_ms"), F.concat(F.lit("p"), "file_id").alias("fingerprint"), F.col("duration_seconds").alias("duration"))


def _listing(f):
    """What listing the tree would give: each file where it is now, and all folders of then and now as opened."""
    null = lambda kind: F.lit(None).cast(kind)
    now = f.select(_new_path().alias("path"), "file_size", F.when(_kind() == 1, 2000).otherwise(1000).cast("long").alias("ms"))
    files = now.select(parent(F.col("path")).alias("folder"), F.lit("file").alias("kind"), "path", F.col("file_size").alias("size"), F.col("ms").alias("modified_ms"), null("string").alias("note"))
    folders = files.select("folder").union(f.select(parent(F.col("normalized_path")))).distinct()
    return files.union(folders.select("folder", F.lit("listed"), "folder", null("long"), F.lit(1).cast("long"), null("string")))


def _described(f):
    return f.where(_kind() >= 2).select(_new_path().alias("normalized_path"), F.when(_kind() == 2, F.concat(F.lit("p"), "file_id")).otherwise(F.concat(F.lit("new"), "file_id")).alias("fingerprint"), F.col("duration_seconds").alias("duration"))


add(
    "scan_compared",
    lambda f: scans.compare(_known(f), _listing(f)).select("status", "normalized_path", "file_id"),
    """
    SELECT CASE file_id % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'changed' ELSE 'missing' END AS status, normalized_path, file_id FROM files
    UNION ALL SELECT 'new', CASE file_id % 4 WHEN 2 THEN concat('moved/', normalized_path) ELSE concat(normalized_path, '.flac') END, NULL FROM files WHERE file_id % 4 >= 2
    """,
    ("files",),
)
add(
    "scan_changes",
    lambda f: scans.with_moves(scans.compare(_known(f), _listing(f)), _described(f)),
    """
    SELECT 'changed' AS status, normalized_path, CAST(NULL AS VARCHAR) AS old_path, file_id FROM files WHERE file_id % 4 = 1
    UNION ALL SELECT 'moved', concat('moved/', normalized_path), normalized_path, file_id FROM files WHERE file_id % 4 = 2
    UNION ALL SELECT 'missing', normalized_path, NULL, file_id FROM files WHERE file_id % 4 = 3
    UNION ALL SELECT 'new', concat(normalized_path, '.flac'), NULL, NULL FROM files WHERE file_id % 4 = 3
    """,
    ("files",),
)


def _files_after(f):
    compared = scans.compare(_known(f), _listing(f))
    changed = scans.with_moves(compared, _described(f))
    # new files get their numbers here from the ones that went
    given = changed.withColumn("file_id", F.coalesce("file_id", -F.regexp_extract("normalized_path", r"/(\d+)\.flac\.flac$", 1).cast("long")))
    return scans.files_after(_known(f), compared, given, _described(f)).select("file_id", "normalized_path", "modified_ms", "fingerprint")


add(
    "scan_files_after",
    _files_after,
    """
    SELECT CASE file_id % 4 WHEN 3 THEN -file_id ELSE file_id END AS file_id,
      CASE file_id % 4 WHEN 2 THEN concat('moved/', normalized_path) WHEN 3 THEN concat(normalized_path, '.flac') ELSE normalized_path END AS normalized_path,
      CAST(CASE file_id % 4 WHEN 1 THEN 2000 ELSE 1000 END AS BIGINT) AS modified_ms,
      CASE file_id % 4 WHEN 0 THEN concat('p', file_id) WHEN 1 THEN NULL WHEN 2 THEN concat('p', file_id) ELSE concat('new', file_id) END AS fingerprint
    FROM files
    """,
    ("files",),
)

# a sync: the player has all files but those of one library in five, under a prefix, with plays by their size; what is stored are links and plays of before
_SYNC = ("files", "nd_links", "plays")


def _songs(f):
    return f.where("library_id <> 3").select(
        F.concat(F.lit("nd"), "file_id").alias("nd_id"), F.concat(F.lit("/srv/music/"), "normalized_path").alias("nd_path"),
        (F.col("file_id") % 3).alias("play_count"), (F.col("file_id") * 10).alias("last_played_ms"),
    )


def _stored(k, p):
    plays = p.select("user_id", F.concat(F.lit("nd"), "nd_id").alias("nd_id"), "playcount", F.unix_millis(F.col("last_played").cast("timestamp")).alias("last_played"))
    links = k.select("nd_id", F.when(F.col("file_id") % 7 == 0, F.col("file_id") + 1).otherwise(F.col("file_id")).alias("file_id"))
    return k.select("nd_id"), links, plays


def _log(f, k, p):
    songs = _songs(f)
    return sync.changes(sync.target(songs, f, sync.detect_prefix(songs, f)), 1, *_stored(k, p))


_SYNCED = """
, want AS (
  SELECT concat('nd', file_id) AS nd_id, (SELECT min(file_id) FROM files g WHERE g.normalized_path = f.normalized_path) AS file_id, CASE WHEN file_id % 3 > 0 THEN file_id % 3 END AS n, CASE WHEN file_id % 3 > 0 THEN file_id * 10 END AS last
  FROM files f WHERE library_id <> 3),
l AS (SELECT nd_id, CASE WHEN file_id % 7 = 0 THEN file_id + 1 ELSE file_id END AS file_id FROM nd_links),
p AS (SELECT user_id, concat('nd', nd_id) AS nd_id, playcount, epoch_ms(CAST(last_played AS TIMESTAMP)) AS last FROM plays),
mine AS (SELECT * FROM p WHERE user_id = 1),
gone AS (SELECT nd_id FROM nd_links WHERE nd_id NOT IN (SELECT nd_id FROM want))
"""
add(
    "sync_changes",
    _log,
    _SYNCED
    + """
    SELECT 'track' AS entity, 'insert' AS action, nd_id, CAST(NULL AS BIGINT) AS user_id, CAST(NULL AS BIGINT) AS old_file_id, CAST(NULL AS BIGINT) AS new_file_id, CAST(NULL AS BIGINT) AS old_count, CAST(NULL AS BIGINT) AS new_count, CAST(NULL AS BIGINT) AS old_last, CAST(NULL AS BIGINT) AS new_last
    FROM want WHERE nd_id NOT IN (SELECT nd_id FROM nd_links)
    UNION ALL SELECT 'track', 'delete', nd_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM gone
    UNION ALL SELECT 'link', CASE WHEN w.nd_id IS NULL THEN 'delete' WHEN l.nd_id IS NULL THEN 'insert' ELSE 'update' END, coalesce(w.nd_id, l.nd_id), NULL, l.file_id, w.file_id, NULL, NULL, NULL, NULL
      FROM want w FULL JOIN l ON l.nd_id = w.nd_id WHERE l.file_id IS DISTINCT FROM w.file_id
    UNION ALL SELECT 'play', CASE WHEN w.n IS NULL THEN 'delete' WHEN m.nd_id IS NULL THEN 'insert' ELSE 'update' END, coalesce(w.nd_id, m.nd_id), 1, NULL, NULL, m.playcount, w.n, m.last, w.last
      FROM want w FULL JOIN mine m ON m.nd_id = w.nd_id WHERE coalesce(w.n, m.playcount) IS NOT NULL AND (w.n IS DISTINCT FROM m.playcount OR w.last IS DISTINCT FROM m.last)
    UNION ALL SELECT 'play', 'delete', nd_id, user_id, NULL, NULL, playcount, NULL, last, NULL FROM p WHERE user_id <> 1 AND nd_id IN (SELECT nd_id FROM gone)
    """,
    _SYNC,
)
add(
    "sync_applied",
    lambda f, k, p: sync.applied(_log(f, k, p), *_stored(k, p))["plays"],
    _SYNCED
    + """
    SELECT CAST(1 AS BIGINT) AS user_id, nd_id, n AS playcount, last AS last_played FROM want WHERE n IS NOT NULL
    UNION ALL SELECT user_id, nd_id, playcount, last FROM p WHERE user_id <> 1 AND nd_id NOT IN (SELECT nd_id FROM gone)
    """,
    _SYNC,
)


# documents: a playlist an artist
def _lists(f):
    lists = f.groupBy("artist").agg(F.min("file_id").alias("playlist_id")).select("playlist_id", F.concat(F.col("artist"), F.lit("?")).alias("name"), F.lit("http://x").alias("source_url"), F.lit(None).cast("string").alias("platform"))
    status = F.element_at(F.array(*map(F.lit, ("isrc", "exact", "fuzzy", "ambiguous", "not_found"))), (F.col("library_id") + 1).cast("int"))
    entries = f.join(lists.select("playlist_id", F.expr("left(name, length(name) - 1)").alias("artist")), "artist").select("playlist_id", (-F.col("file_id")).alias("nth"), status.alias("status"), F.col("normalized_path").alias("path"), F.floor(F.col("duration_seconds") * 1000).alias("duration_ms"), "artist", "title")
    lines = playlists.m3u_documents(lists, entries)
    return lines.select("document", F.row_number().over(Window.partitionBy("document").orderBy("nth")).alias("nth"), "line")


add(
    "m3u_documents",
    _lists,
    r"""
    , h AS (SELECT DISTINCT artist, unnest([0, 1, 2, 3]) AS k FROM files),
    lines AS (
      SELECT artist, 0 AS part, CAST(k AS BIGINT) AS place, 0 AS i, CASE k WHEN 0 THEN '#EXTM3U' WHEN 1 THEN concat('#PLAYLIST:', artist, '?') WHEN 2 THEN '# Source: http://x' ELSE '' END AS line FROM h
      UNION ALL SELECT artist, 1, -file_id, 0, concat('#EXTINF:', CAST(floor(duration_seconds) AS BIGINT), ',', artist, ' - ', title) FROM files WHERE library_id < 3
      UNION ALL SELECT artist, 1, -file_id, 1, normalized_path FROM files WHERE library_id < 3)
    SELECT concat(artist, '_.m3u') AS document, CAST(row_number() OVER (PARTITION BY artist ORDER BY part, place, i) AS INTEGER) AS nth, line FROM lines
    """,
    ("files",),
)


def _sidecars(s):
    """The sidecars' lines, read again."""
    states = s.groupBy("calibration_key", (F.col("snapshot_at") % 3).alias("k")).agg(F.min("p5").alias("p5"), F.max("p95").alias("p95")).select(F.col("calibration_key").alias("head_name"), F.concat(F.lit("label"), "k").alias("label"), "p5", "p95")
    heads = states.select("head_name", F.concat(F.lit("models/"), "head_name", F.lit(".onnx")).alias("model"), F.lit("multiclass").alias("head_type"), F.lit("effnet").alias("backbone")).distinct()
    lines = playlists.sidecars(states, heads, 2, 100)
    parsed = F.from_json("line", "calibration_version int, model string, labels map<string, struct<p5: double, p95: double>>")
    return lines.select("document", parsed.alias("j")).select("document", "j.calibration_version", "j.model", F.explode("j.labels").alias("label", "c")).select("document", "calibration_version", "model", "label", "c.p5", "c.p95")


add(
    "calibration_sidecars",
    _sidecars,
    """
    SELECT concat('models/', calibration_key, '-calibration-v2.json') AS document, CAST(2 AS INTEGER) AS calibration_version, calibration_key AS model, concat('label', snapshot_at % 3) AS label, min(p5) AS p5, max(p95) AS p95
    FROM snapshots GROUP BY calibration_key, snapshot_at % 3
    """,
    ("snapshots",),
)

# pooling: two scores a segment, one of them not a number now and then
def _odd():
    return F.when(F.col("segment_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("score_a").cast("double"))


def _pooled(mode, omit=True):
    return lambda s: scores.pool_scores(s.select("file_id", F.array(_odd(), F.when(F.col("file_id") % 3 > 0, F.col("score_b").cast("double"))).alias("scores")), mode, 0.2, omit).withColumn("value", F.round("value", 6) + 0.0)


_EACH = """
, e AS (
  SELECT file_id, 0 AS dim, CASE WHEN segment_id % 5 <> 0 THEN CAST(score_a AS DOUBLE) END AS x FROM segments
  UNION ALL SELECT file_id, 1, CASE WHEN file_id % 3 > 0 THEN CAST(score_b AS DOUBLE) END FROM segments),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id, dim ORDER BY x NULLS LAST) AS k, count(*) OVER (PARTITION BY file_id, dim) AS n, count(x) OVER (PARTITION BY file_id, dim) AS m FROM e)
"""
add("pool_mean", _pooled("mean"), _EACH + "SELECT file_id, dim, round(coalesce(avg(x), 0), 6) + 0.0e0 AS value FROM e GROUP BY file_id, dim", ("segments",))
add("pool_median", _pooled("median"), _EACH + "SELECT file_id, dim, round(coalesce(median(x), 0), 6) + 0.0e0 AS value FROM e GROUP BY file_id, dim", ("segments",))
add(
    "pool_trimmed_mean",
    _pooled("trimmed_mean", False),
    _EACH
    + """
    SELECT file_id, dim, round(coalesce(avg(x) FILTER (WHERE k > floor(n * 0.2e0) AND k <= m - floor(n * 0.2e0) OR m <= 2 * floor(n * 0.2e0)), 0), 6) + 0.0e0 AS value
    FROM r GROUP BY file_id, dim
    """,
    ("segments",),
)
