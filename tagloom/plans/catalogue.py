"""The query catalogue and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curation, drift, heads, library, matching, moods, personal, scores, tags, vectors
from ..sources.views import view
from ..streaming import scrobbles
from .registry import ORACLE_SQL, QUERIES, add  # noqa: F401

RULES = tags.Rules("OR", (tags.Condition("genre", "=", "ring"),), (tags.Rules("AND", (tags.Condition("nom:energy", ">", 0.9), tags.Condition("nom:mood-strict", "CONTAINS", "urgent"))),))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _playlist(view(spark, sf_dir, "tags_long"), view(spark, sf_dir, "files"))


def _playlist(t: DataFrame, f: DataFrame) -> DataFrame:
    return f.join(tags.files_for_rules(t, RULES), "file_id").select("file_id", "artist", "album", "title")


def _renamed(f: DataFrame, every: int, below: str) -> DataFrame:
    return f.withColumn("normalized_path", F.concat(F.when(F.col("file_id") % every == 0, below).otherwise(""), "normalized_path"))


T, FI, ME, PL, SE, VE = ("tags_long",), ("files",), ("mood_edges",), ("plays",), ("segments",), ("vectors",)

# tags
add("tags_list_by_count", lambda t: tags.page(tags.tags_by_rel(t, "genre"), [F.col("song_count").desc(), "value"], 0, 10), "SELECT value_str AS value, count(DISTINCT file_id) AS song_count FROM tags_long WHERE rel = 'genre' AND value_str IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", T)
add("tags_list_by_value", lambda t: tags.page(tags.tags_by_rel(t, "artist"), ["value"], 5, 10), "SELECT value_str AS value, count(DISTINCT file_id) AS song_count FROM tags_long WHERE rel = 'artist' AND value_str IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 10 OFFSET 5", T)
add("tags_search", lambda t: tags.tags_by_rel(t, "genre", "IN"), "SELECT value_str AS value, count(DISTINCT file_id) AS song_count FROM tags_long WHERE rel = 'genre' AND contains(lower(value_str), 'in') GROUP BY 1", T)
add("unique_rels", lambda t: tags.unique_rels(t), "SELECT DISTINCT rel FROM tags_long", T)
add("unique_rels_prefix", lambda t: tags.unique_rels(t, "nom:"), "SELECT DISTINCT rel FROM tags_long WHERE starts_with(rel, 'nom:')", T)
add("tag_edge_stats", lambda t: tags.tag_stats(t), """, p AS (SELECT rel, file_id, count(*) AS n, count(value_num) AS nums, min(value_num) AS lo, max(value_num) AS hi FROM tags_long GROUP BY 1, 2),
v AS (SELECT rel, count(DISTINCT value_str) AS s FROM tags_long WHERE value_str IS NOT NULL GROUP BY 1)
SELECT p.rel, CAST(sum(n) AS BIGINT) AS total, count(*) AS files, 2 * sum(nums) > sum(n) AS numeric, max(n) > 1 AS multivalue, min(lo) AS min_value, max(hi) AS max_value, coalesce(any_value(v.s), 0) AS string_values FROM p LEFT JOIN v ON p.rel = v.rel GROUP BY p.rel""", T)
add("song_tags_grouped", lambda t: tags.grouped_tags(t), "SELECT file_id, rel, string_agg(value_str, '|' ORDER BY value_str) AS values FROM tags_long WHERE value_str IS NOT NULL GROUP BY 1, 2", T)
add("song_tags_prefix", lambda t: tags.grouped_tags(t, "nom:"), "SELECT file_id, rel, string_agg(value_str, '|' ORDER BY value_str) AS values FROM tags_long WHERE value_str IS NOT NULL AND starts_with(rel, 'nom:') GROUP BY 1, 2", T)
for _name, _op, _sql in (("eq", "=", "value_num = 0.9e0"), ("ne", "!=", "(value_num IS NULL OR value_num <> 0.9e0)"), ("gt", ">", "(value_str IS NOT NULL OR value_num > 0.9e0)"), ("lt", "<", "((value_str IS NULL AND value_num IS NULL) OR value_num < 0.9e0)"), ("ge", ">=", "(value_str IS NOT NULL OR value_num >= 0.9e0)"), ("le", "<=", "((value_str IS NULL AND value_num IS NULL) OR value_num <= 0.9e0)")):
    add(f"match_tag_{_name}", (lambda op: lambda t: tags.files_matching(t, "nom:energy", op, 0.9))(_op), f"SELECT DISTINCT file_id FROM tags_long WHERE rel = 'nom:energy' AND {_sql}", T)
add("match_tag_contains", lambda t: tags.files_matching(t, "genre", "CONTAINS", "IN"), "SELECT DISTINCT file_id FROM tags_long WHERE rel = 'genre' AND contains(lower(value_str), 'in')", T)
add("match_tag_notcontains", lambda t: tags.files_matching(t, "genre", "NOTCONTAINS", "in"), "SELECT DISTINCT file_id FROM tags_long WHERE rel = 'genre' AND NOT coalesce(contains(lower(value_str), 'in'), false)", T)
add("playlist_rules", _playlist, "SELECT file_id, artist, album, title FROM files WHERE file_id IN (SELECT file_id FROM tags_long WHERE rel = 'genre' AND value_str = 'ring') OR (file_id IN (SELECT file_id FROM tags_long WHERE rel = 'nom:energy' AND value_num > 0.9e0) AND file_id IN (SELECT file_id FROM tags_long WHERE rel = 'nom:mood-strict' AND contains(lower(value_str), 'urgent')))", ("tags_long", "files"))
add("tag_cooccurrence", lambda t: tags.cooccurrence(t, "genre", "album"), "SELECT x.value_str AS x, y.value_str AS y, count(DISTINCT x.file_id) AS n_files FROM tags_long x JOIN tags_long y ON x.file_id = y.file_id WHERE x.rel = 'genre' AND y.rel = 'album' GROUP BY 1, 2", T)
add("year_distribution", lambda t: tags.number_distribution(t, "year"), "SELECT CAST(value_num AS BIGINT) AS value, count(DISTINCT file_id) AS n_files FROM tags_long WHERE rel = 'year' AND value_num IS NOT NULL GROUP BY 1", T)
add("genre_distribution", lambda t: tags.top(tags.tags_by_rel(t, "genre"), "song_count", "value", 5), "SELECT value_str AS value, count(DISTINCT file_id) AS song_count FROM tags_long WHERE rel = 'genre' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", T)
add("files_by_tag_nearest", lambda t: tags.nearest(t, "nom:energy", 0.9, 20), "SELECT file_id, round(abs(value_num - 0.9e0), 6) AS distance FROM tags_long WHERE rel = 'nom:energy' ORDER BY 2, 1 LIMIT 20", T)
add("relink_tags", lambda t: curation.relinked(t, "genre", ["ring"], "small").groupBy("rel", "value_str").agg(F.count("*").alias("n")), "SELECT rel, value_str, count(*) AS n FROM (SELECT DISTINCT file_id, rel, CASE WHEN rel = 'genre' AND value_str = 'ring' THEN 'small' ELSE value_str END AS value_str, value_num FROM tags_long) GROUP BY 1, 2", T)
add(
    "orphan_tags",
    # every seventh file has another id in the tags
    lambda t, f: tags.orphans(t.withColumn("file_id", F.when(F.col("file_id") % 7 == 0, F.col("file_id") + 10**9).otherwise(F.col("file_id"))), f).groupBy("rel").agg(F.count("*").alias("n")),
    "SELECT rel, count(*) AS n FROM tags_long WHERE file_id % 7 = 0 GROUP BY 1",
    ("tags_long", "files"),
)

# files
add("library_overview", library.overview, "SELECT count(*) AS n_files, count(DISTINCT artist) AS artists, count(DISTINCT album) AS albums, CAST(floor(sum(duration_seconds) * 1000) AS BIGINT) AS total_ms, CAST(sum(file_size) AS BIGINT) AS total_size, round(sum(duration_seconds) * 1000 / count(*), 3) AS avg_ms FROM files", FI)
add("library_counts", library.per_library, "SELECT library_id, count(*) AS n_files, count(DISTINCT regexp_replace(normalized_path, '/[^/]*$', '')) AS n_folders FROM files GROUP BY 1", FI)
add("artist_frequencies", lambda f: tags.top(library.frequencies(f, "artist"), "n_files", "value", 10), "SELECT artist AS value, count(*) AS n_files FROM files GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", FI)
add("files_search", lambda f: library.search(f, "RING", album="PROMO").select("file_id", "artist", "title"), "SELECT file_id, artist, title FROM files WHERE (lower(artist) LIKE '%ring%' OR lower(album) LIKE '%ring%' OR lower(title) LIKE '%ring%') AND album = 'PROMO'", FI)
add("files_in_folder", lambda f: library.in_folder(f, "PROMO").select("file_id", "normalized_path"), "SELECT file_id, normalized_path FROM files WHERE starts_with(normalized_path, 'PROMO/')", FI)
add("albums_of_artist", lambda f: f.groupBy("artist", "album").agg(F.count("*").alias("n_files")), "SELECT artist, album, count(*) AS n_files FROM files GROUP BY 1, 2", FI)
add(
    "scan_diff",
    # all files are on both sides: some under other names, some with other sizes
    lambda f: library.scan_diff(_renamed(f, 11, "gone/"), _renamed(f, 13, "new/").withColumn("file_size", F.col("file_size") + F.when(F.col("file_id") % 5 == 0, 1).otherwise(0))),
    """
    , k AS (SELECT concat(CASE WHEN file_id % 11 = 0 THEN 'gone/' ELSE '' END, normalized_path) AS p, file_size AS w FROM files),
    s AS (SELECT concat(CASE WHEN file_id % 13 = 0 THEN 'new/' ELSE '' END, normalized_path) AS p, file_size + CASE WHEN file_id % 5 = 0 THEN 1 ELSE 0 END AS i FROM files)
    SELECT coalesce(k.p, s.p) AS normalized_path, CASE WHEN w IS NULL THEN 'new' WHEN i IS NULL THEN 'missing' WHEN w <> i THEN 'changed' ELSE 'same' END AS status FROM k FULL JOIN s ON k.p = s.p
    """,
    FI,
)
add("m3u_lines", library.m3u, "SELECT file_id, '#EXTINF:' || CAST(CAST(floor(duration_seconds) AS BIGINT) AS VARCHAR) || ',' || artist || ' - ' || title AS info, normalized_path AS path FROM files", FI)

# moods
add("mood_coverage", moods.coverage, "SELECT rel, count(DISTINCT file_id) AS tagged, round(100.0e0 * count(DISTINCT file_id) / (SELECT count(*) FROM files), 1) AS pct FROM mood_edges GROUP BY 1", ("mood_edges", "files"))
add("mood_balance", moods.balance, "SELECT rel, value_str AS mood, count(*) AS n FROM mood_edges GROUP BY 1, 2", ME)
for _tier in moods.TIERS:
    _in = ", ".join(f"'{r}'" for r in moods.tier_rels(_tier))
    add(f"mood_pairs_{_tier}", (lambda tier: lambda e: moods.pairs(e, tier))(_tier), f", m AS (SELECT DISTINCT file_id, value_str FROM mood_edges WHERE rel IN ({_in})) SELECT a.value_str AS mood1, b.value_str AS mood2, count(*) AS n_files FROM m a JOIN m b ON a.file_id = b.file_id AND a.value_str < b.value_str GROUP BY 1, 2", ME)
add("dominant_vibes", moods.dominant, "SELECT value_str AS mood, count(*) AS n, round(100.0e0 * count(*) / (SELECT count(*) FROM mood_edges), 1) AS pct FROM mood_edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", ME)
add("mood_correlation", moods.correlation, ", o AS (SELECT DISTINCT file_id, value_str FROM mood_edges), c AS (SELECT value_str AS mood, count(*) AS m FROM o GROUP BY 1) SELECT a.value_str AS mood, b.value_str AS other, round(CAST(count(*) AS DOUBLE) / any_value(c.m), 6) AS p FROM o a JOIN o b ON a.file_id = b.file_id AND a.value_str <> b.value_str JOIN c ON c.mood = a.value_str GROUP BY 1, 2", ME)

# scores and calibration
_STATS = "SELECT file_id, count(score_a) AS n, round(avg(score_a), 6) AS mean, round(stddev_pop(score_a), 6) AS std, min(score_a) AS least, max(score_a) AS largest FROM segments GROUP BY 1"
add("segment_stats", lambda s: scores.segment_stats(s, "score_a"), _STATS, SE)
add("high_variance_files", lambda s: scores.high_variance(scores.segment_stats(s, "score_a"), 0.33), f"SELECT * FROM ({_STATS}) WHERE std > 0.33e0", SE)
add("regression_tiers", lambda s: scores.segment_stats(s, "score_a").groupBy(scores.tier(F.col("mean"), F.col("std")).alias("tier")).agg(F.count("*").alias("n_files")), f", st AS ({_STATS}) SELECT CASE WHEN mean >= 0.7e0 THEN 'high' WHEN mean <= 0.3e0 THEN 'low' ELSE 'none' END || ':' || CASE WHEN std < 0.1e0 THEN 'strict' WHEN std < 0.2e0 THEN 'regular' WHEN std < 0.35e0 THEN 'loose' ELSE 'untiered' END AS tier, count(*) AS n_files FROM st GROUP BY 1", SE)
add("trimmed_mean_pool", lambda s: scores.trimmed_mean(s, "score_b"), ", r AS (SELECT file_id, score_b AS x, row_number() OVER (PARTITION BY file_id ORDER BY score_b, segment_id) AS r, count(*) OVER (PARTITION BY file_id) AS n FROM segments) SELECT file_id, round(avg(x), 6) AS pooled, count(*) AS used FROM r WHERE r > floor(n * 0.1e0) AND r <= n - floor(n * 0.1e0) GROUP BY 1", SE)
_HIST = "SELECT CAST(least(greatest(floor((value_num - 0.0e0) / (1.0e0 / 10000)), 0), 9999) AS BIGINT) AS bin, count(*) AS n, CAST(sum(CASE WHEN value_num < 0.0e0 THEN 1 ELSE 0 END) AS BIGINT) AS underflow, CAST(sum(CASE WHEN value_num > 1.0e0 THEN 1 ELSE 0 END) AS BIGINT) AS overflow FROM tags_long WHERE rel = 'nom:calm' GROUP BY 1"
add("calib_histogram", lambda t: scores.histogram(t.where("rel = 'nom:calm'"), "value_num"), _HIST, T)
_CUM = f", h AS ({_HIST}), c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS cum, sum(n) OVER () AS total FROM h)"
_PCT = "SELECT round(min(CASE WHEN cum >= total * 0.05e0 THEN bin END) * (1.0e0 / 10000), 6) AS p5, round(min(CASE WHEN cum >= total * 0.95e0 THEN bin END) * (1.0e0 / 10000), 6) AS p95, CAST(max(total) AS BIGINT) AS n FROM c"
add("calib_percentiles", lambda t: scores.percentiles(scores.histogram(t.where("rel = 'nom:calm'"), "value_num")), f"{_CUM} {_PCT}", T)


def _calibrated(t: DataFrame) -> DataFrame:
    own = t.where("rel = 'nom:calm'")
    p = scores.percentiles(scores.histogram(own, "value_num")).withColumn("one", F.lit(1))
    return own.withColumn("one", F.lit(1)).join(F.broadcast(p), "one").select("file_id", F.round(scores.calibrated(F.col("value_num"), F.col("p5"), F.col("p95")), 6).alias("value"))


add("calib_apply", _calibrated, f"{_CUM}, p AS ({_PCT}) SELECT file_id, round(least(greatest((value_num - p5) / (p95 - p5), 0.0e0), 1.0e0), 6) AS value FROM tags_long, p WHERE rel = 'nom:calm'", T)

# vectors
_UNIT = ", u AS (SELECT file_id, genre_id, CAST(vector AS DOUBLE[]) AS v FROM vectors)"
add("vector_topk", lambda v: vectors.search(v, 7, 10), _UNIT + " SELECT a.file_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM u a, u b WHERE b.file_id = 7 AND a.file_id <> 7 ORDER BY 2 DESC, 1 LIMIT 10", VE)
add("vector_topk_genre", lambda v: vectors.search(v, 7, 10, 1), _UNIT + " SELECT a.file_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM u a, u b WHERE b.file_id = 7 AND a.file_id <> 7 AND a.genre_id = 1 ORDER BY 2 DESC, 1 LIMIT 10", VE)
add("nlists_nprobe", lambda v: v.groupBy("genre_id").agg(F.count("*").alias("docs")).select("genre_id", vectors.nlists(F.col("docs")).alias("lists"), vectors.nprobe(vectors.nlists(F.col("docs"))).alias("probes")), ", c AS (SELECT genre_id, count(*) AS docs FROM vectors GROUP BY 1), l AS (SELECT genre_id, CAST(least(greatest(floor(docs / 15), 10), 4000) AS BIGINT) AS lists FROM c) SELECT genre_id, lists, CAST(least(greatest(floor(lists * 10 / 100), 1), lists) AS BIGINT) AS probes FROM l", VE)

# plays
add("plays_top", lambda p: personal.top_tracks(p, 3), "SELECT user_id, nd_id, playcount, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY playcount DESC, last_played DESC, nd_id) AS rank FROM plays) WHERE rank <= 3", PL)
add("plays_most_users", lambda p: personal.most_users(p, 25), "SELECT nd_id, count(*) AS users, CAST(sum(playcount) AS BIGINT) AS plays FROM plays GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 25", PL)
add("plays_least_by_others", lambda p: personal.least_by_others(p, 1, 25), "SELECT nd_id, CAST(sum(playcount) AS BIGINT) AS plays FROM plays WHERE nd_id NOT IN (SELECT nd_id FROM plays WHERE user_id = 1) GROUP BY 1 ORDER BY 2, 1 LIMIT 25", PL)
add("genre_shares", personal.genre_shares, ", g AS (SELECT DISTINCT file_id, value_str FROM tags_long WHERE rel = 'genre') SELECT user_id, value_str AS genre, CAST(sum(playcount) AS BIGINT) AS plays FROM plays JOIN g ON nd_id = file_id GROUP BY 1, 2", ("plays", "tags_long"))


# merging, splitting and setting tags; what files lack
add("tag_value_to_parts", lambda t: tags.split_value(t, "genre", "ring", ["hoop", "small"]).groupBy("rel", "value_str").agg(F.count("*").alias("n")), "SELECT rel, value_str, count(*) AS n FROM (SELECT DISTINCT file_id, rel, unnest(CASE WHEN rel = 'genre' AND value_str = 'ring' THEN ['hoop', 'small'] ELSE [value_str] END) AS value_str, value_num FROM tags_long) GROUP BY 1, 2", T)
add("set_song_tags", lambda t, f: tags.set_tags(t, "genre", f.where("file_id % 3 = 0").select("file_id", F.col("artist").alias("value_str"))).groupBy("rel", "value_str").agg(F.count("*").alias("n")), "SELECT rel, value_str, count(*) AS n FROM (SELECT rel, value_str FROM tags_long WHERE NOT (rel = 'genre' AND file_id % 3 = 0) UNION ALL SELECT 'genre', artist FROM files WHERE file_id % 3 = 0) GROUP BY 1, 2", ("tags_long", "files"))
add("incomplete_tags", lambda f, t: tags.incomplete(f, t, ["nom:mood-strict", "nom:mood-loose", "artist"]), ", h AS (SELECT file_id, count(DISTINCT rel) AS has FROM tags_long WHERE rel IN ('nom:mood-strict', 'nom:mood-loose', 'artist') GROUP BY 1) SELECT f.file_id, 3 - coalesce(has, 0) AS lacks FROM files f LEFT JOIN h ON f.file_id = h.file_id WHERE coalesce(has, 0) < 3", ("files", "tags_long"))
add("tag_value_counts", tags.value_counts, "SELECT rel, count(*) AS n_values FROM (SELECT DISTINCT rel, value_str, value_num FROM tags_long) GROUP BY 1", T)
add("artist_genre_counts", lambda t: tags.cooccurrence(t, "artist", "genre"), "SELECT x.value_str AS x, y.value_str AS y, count(DISTINCT x.file_id) AS n_files FROM tags_long x JOIN tags_long y ON x.file_id = y.file_id WHERE x.rel = 'artist' AND y.rel = 'genre' GROUP BY 1, 2", T)
add("inclusive_moods", moods.inclusive, """, t AS (SELECT * FROM (VALUES ('nom:mood-strict', 0), ('nom:mood-regular', 1), ('nom:mood-loose', 2)) v(name, i)), d AS (SELECT DISTINCT e.file_id, o.name AS rel, e.value_str FROM mood_edges e JOIN t ON t.name = e.rel JOIN t o ON o.i >= t.i)
SELECT file_id, rel, string_agg(value_str, '|' ORDER BY value_str) AS moods FROM d GROUP BY 1, 2""", ME)
add(
    "scan_plan",
    lambda f: library.scan_plan(library.folders(f), library.folders(f.withColumn("file_size", F.col("file_size") + F.when(F.col("file_id") % 40 == 0, 1).otherwise(0)))),
    """
    , a AS (SELECT regexp_replace(normalized_path, '/[^/]*$', '') AS folder, count(*) AS file_count, count_if(file_id % 40 = 0) AS other FROM files GROUP BY 1)
    SELECT folder, file_count, other > 0 AS scan FROM a
    """,
    FI,
)

# head decisions, drift
add("head_decisions", lambda s: heads.decide(s.groupBy("segment_id").agg(F.max("score_a").alias("score_a"), F.max("score_b").alias("score_b")).select(F.col("segment_id").alias("file_id"), F.expr("stack(2, 'a', score_a, 'b', score_b) AS (label, p)"), F.round(F.col("score_b") / 4, 6).alias("std"))), """, g AS (SELECT segment_id, max(score_a) AS score_a, max(score_b) AS score_b FROM segments GROUP BY 1), l AS (SELECT segment_id AS file_id, 'a' AS label, score_a AS p, least(score_b, 1.0e0) AS counter, round(score_b / 4, 6) AS std FROM g UNION ALL SELECT segment_id, 'b', score_b, least(score_a, 1.0e0), round(score_b / 4, 6) FROM g),
t AS (SELECT file_id, label, p, counter, CASE WHEN p >= 0.8e0 AND p / greatest(counter, 1e-9) >= 1.2e0 AND p - counter >= 0.15e0 AND std < 0.08e0 THEN 'high' WHEN p >= 0.75e0 AND p / greatest(counter, 1e-9) >= 1.1e0 AND p - counter >= 0.08e0 AND std < 0.15e0 THEN 'medium' WHEN p >= 0.6e0 AND p / greatest(counter, 1e-9) >= 1.02e0 AND p - counter >= 0.03e0 AND std < 0.25e0 THEN 'low' END AS tier FROM l) SELECT * FROM t WHERE tier IS NOT NULL""", SE)


def _sides(t: DataFrame) -> DataFrame:
    return t.where("rel = 'nom:calm'").select(F.when(F.col("file_id") % 2 == 0, "old").otherwise("new").alias("side"), F.col("value_num").alias("v"))


_SIDE = ", s AS (SELECT CASE WHEN file_id % 2 = 0 THEN 'old' ELSE 'new' END AS side, value_num AS v FROM tags_long WHERE rel = 'nom:calm')"
add("jsd_drift", lambda t: drift.divergence(_sides(t)), _SIDE + """, b AS (SELECT least(floor(v * 100), 99) AS bin, count_if(side = 'old') AS o, count_if(side = 'new') AS n FROM s WHERE v BETWEEN 0 AND 1 GROUP BY 1), c AS (SELECT o / sum(o) OVER () AS p, n / sum(n) OVER () AS q FROM b)
SELECT round(sum((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2), 6) AS jsd FROM c""", T)
add("median_iqr_drift", lambda t: drift.centre_and_spread(_sides(t)), _SIDE + ", q AS (SELECT quantile_cont(v, [0.25, 0.5, 0.75]) FILTER (side = 'old') AS o, quantile_cont(v, [0.25, 0.5, 0.75]) FILTER (side = 'new') AS n FROM s) SELECT round(abs(n[2] - o[2]), 6) AS median_drift, round(abs((n[3] - n[1]) - (o[3] - o[1])), 6) AS iqr_drift FROM q", T)
add("calib_drift", lambda t: drift.percentile_drift(t.where("rel = 'nom:calm'").select((F.col("file_id") % 20).alias("key"), F.col("file_id").alias("run"), (F.col("value_num") / 100).alias("p5"), (F.col("value_num") / 10).alias("p95"))), ", h AS (SELECT file_id % 20 AS key, file_id AS run, value_num / 100 AS p5, value_num / 10 AS p95 FROM tags_long WHERE rel = 'nom:calm'), b AS (SELECT *, lag(p5) OVER w AS b5, lag(p95) OVER w AS b95, row_number() OVER (PARTITION BY key ORDER BY run DESC) AS nth FROM h WINDOW w AS (PARTITION BY key ORDER BY run)) SELECT key, round(abs(p5 - b5), 6) AS apd_p5, round(abs(p95 - b95), 6) AS apd_p95, round(abs((p95 - p5) - (b95 - b5)), 6) AS srd, abs(p5 - b5) < 0.01e0 AND abs(p95 - b95) < 0.01e0 AS settled FROM b WHERE nth = 1 AND b5 IS NOT NULL", T)

# vectors in two tiers, taste, sync, matching
add(
    "track_vector_lookup",
    lambda v: matching.latest(v.select("file_id", F.when(F.col("file_id") % 3 == 0, "cold").otherwise("hot").alias("tier")).union(v.select("file_id", F.lit("hot"))), "file_id", ["tier"]),
    "SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'cold' ELSE 'hot' END AS tier FROM vectors",
    VE,
)
add(
    "sync_diff",
    lambda p, f: personal.sync_status(p.withColumn("nd_id", F.when(F.col("nd_id") % 5 == 0, F.col("nd_id") + 10**9).otherwise(F.col("nd_id"))), f),
    """
    , p AS (SELECT DISTINCT CASE WHEN nd_id % 5 = 0 THEN nd_id + 1000000000 ELSE nd_id END AS nd_id FROM plays)
    SELECT coalesce(f.file_id, nd_id) AS file_id, CASE WHEN f.file_id IS NULL THEN 'orphan' WHEN nd_id IS NULL THEN 'unplayed' ELSE 'matched' END AS status FROM files f FULL JOIN p ON f.file_id = nd_id
    """,
    ("plays", "files"),
)


def _matched(f: DataFrame) -> DataFrame:
    isrc = F.when(F.col("file_id") % 4 == 0, F.concat(F.lit("I"), F.col("file_id")))
    asked = f.select(F.col("file_id").alias("track_id"), isrc.alias("isrc"), F.concat(F.lit("  "), F.upper("title"), F.lit(" (Remastered 2011)")).alias("title"), F.concat(F.lit("The "), F.col("artist")).alias("artist"))
    other = F.col("file_id") % 9 == 0
    return matching.match(asked, f.withColumn("isrc", F.when(~other, isrc)).withColumn("title", F.when(other, F.concat(F.lit("other "), "title")).otherwise(F.col("title"))))


def _printed(f: DataFrame, at: str, off: float) -> DataFrame:
    """Files with a fingerprint each, under paths below `at`."""
    return f.select("file_id", F.concat(F.lit(at), "normalized_path").alias("path"), F.concat_ws(":", "title", "file_id").alias("fingerprint"), (F.col("duration_seconds") + F.col("file_id") % 3 * off).alias("duration"))


add(
    "match_isrc_exact",
    _matched,
    """
    , k AS (SELECT file_id, concat(CASE WHEN file_id % 9 = 0 THEN 'other ' ELSE '' END, lower(title)) AS t, artist AS a FROM files),
    n AS (SELECT t, a, min(file_id) AS m FROM k GROUP BY 1, 2)
    SELECT f.file_id AS track_id, CASE WHEN f.file_id % 4 = 0 AND f.file_id % 9 <> 0 THEN 'isrc' WHEN m IS NOT NULL THEN 'exact' ELSE 'not_found' END AS status,
      CASE WHEN f.file_id % 4 = 0 AND f.file_id % 9 <> 0 THEN f.file_id ELSE m END AS file_id FROM files f LEFT JOIN n ON lower(f.title) = n.t AND f.artist = n.a
    """,
    FI,
)
add(
    "file_moves",
    # every file under a new path, its length further and further off
    lambda f: matching.moves(_printed(f, "old/", 0.0), _printed(f, "new/", 0.8)),
    """
    SELECT file_id, concat('old/', normalized_path) AS old_path, concat('new/', normalized_path) AS new_path FROM files WHERE file_id % 3 < 2
    """,
    FI,
)


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts is not null")
    return events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_millis("w.start").alias("start_ms"), "event_type", "n")


QUERIES["ext_tumbling"] = _hourly
ORACLE_SQL["ext_tumbling"] = "SELECT epoch_ms(date_trunc('hour', ts)) AS start_ms, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"


def _scrobbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null and ts is not null")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return scrobbles.play_counts_batch(events.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("nd_id"), ms.alias("ts_ms")))


QUERIES["scrobble_counts"] = _scrobbles
# from each accepted play to the first event that lies far enough behind it
ORACLE_SQL["scrobble_counts"] = """
WITH RECURSIVE e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS nd_id, epoch_us(ts) // 1000 AS t FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
acc AS (
  SELECT user_id, nd_id, min(t) AS t FROM e WHERE t >= 0 GROUP BY user_id, nd_id
  UNION ALL
  SELECT a.user_id, a.nd_id, min(e.t) FROM acc a JOIN e ON e.user_id = a.user_id AND e.nd_id IS NOT DISTINCT FROM a.nd_id AND e.t >= a.t + 30000 GROUP BY a.user_id, a.nd_id, a.t)
SELECT user_id, nd_id, count(*) AS playcount, max(t) AS last_played FROM acc GROUP BY user_id, nd_id
"""

# the other parts of the catalogue register themselves
from . import analytics_queries, calibration_queries, curation_queries, file_queries, personal_queries, state_queries, store_queries, table_queries, text_queries, vector_queries, workflow_queries  # noqa: E402, F401
