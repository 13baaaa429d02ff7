"""Calibration of all labels, its history and bundles, and moods of heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrated
from ..operators import calibration as cal
from ..operators import sinks
from ..sources.views import with_views
from .registry import ORACLE_SQL, add

T, SN = ("tags_long",), ("snapshots",)
#: Scores of two labels; values run from below 0 to above 1.
SCORES = """
, scores AS (
  SELECT 'energy-head' AS head_name, rel AS label, file_id, CASE WHEN rel = 'nom:energy' THEN value_num * 1.3e0 - 0.2e0 ELSE value_num END AS value FROM tags_long WHERE rel IN ('nom:energy', 'nom:calm'))
"""
HIST = SCORES + """
, hist AS (
  SELECT head_name, label, CAST(least(greatest(floor((value - 0.0e0) / 0.0001e0), 0), 9999) AS BIGINT) AS bin, count(*) AS n, count(*) FILTER (WHERE value < 0) AS underflow, count(*) FILTER (WHERE value > 1) AS overflow
  FROM scores GROUP BY 1, 2, 3)
"""
STATES = HIST + """
, run AS (
  SELECT *, sum(n) OVER (PARTITION BY label ORDER BY bin) + sum(underflow) OVER (PARTITION BY label) AS cum, sum(n) OVER (PARTITION BY label) AS total FROM hist),
state AS (
  SELECT head_name, label, round(coalesce(min(CASE WHEN cum >= total * 0.05e0 THEN bin END) * 0.0001e0, 0.0e0), 6) AS p5, round(coalesce(min(CASE WHEN cum >= total * 0.95e0 THEN bin END) * 0.0001e0, 1.0e0), 6) AS p95,
    CAST(sum(n) AS BIGINT) AS n, CAST(sum(underflow) AS BIGINT) AS underflow_count, CAST(sum(overflow) AS BIGINT) AS overflow_count FROM run GROUP BY 1, 2)
"""


def _scores(t):
    value = F.when(F.col("rel") == "nom:energy", F.col("value_num") * 1.3 - 0.2).otherwise(F.col("value_num"))
    return t.where("rel IN ('nom:energy', 'nom:calm')").select(F.lit("energy-head").alias("head_name"), F.col("rel").alias("label"), "file_id", value.alias("value"))


def _states(t):
    return cal.states(cal.histograms(_scores(t)))


add("calib_histograms", lambda t: cal.histograms(_scores(t)), HIST + "SELECT * FROM hist", T)
add("calib_states", _states, STATES + "SELECT * FROM state", T)
add(
    "calib_fingerprint",
    lambda t: cal.fingerprint(_states(t)),
    STATES + "SELECT md5(string_agg(concat(head_name, ':', label, ':', printf('%.6f', p5), ':', printf('%.6f', p95)), '|' ORDER BY label)) AS version FROM state",
    T,
)
add(
    "calib_applied",
    lambda t: cal.applied(_scores(t), _states(t)).withColumn("value", F.round("value", 6)),
    STATES + "SELECT head_name, label, file_id, round(CASE WHEN p95 > p5 THEN least(greatest((value - p5) / (p95 - p5), 0.0e0), 1.0e0) ELSE value END, 6) AS value FROM scores JOIN state USING (head_name, label)",
    T,
)
add("calib_last_per_label", lambda t: cal.last_per_label(_states(t).union(_states(t).withColumn("head_name", F.lit("zz-head")))), STATES + "SELECT label, 'zz-head' AS head_name, p5, p95 FROM state", T)
add(
    "calib_bundle",
    lambda t: sinks.bundle(_states(t)),
    STATES
    + """
    SELECT head_name, concat('{', string_agg(concat('"', label, '":{"p5":', CAST(p5 AS VARCHAR), ',"p95":', CAST(p95 AS VARCHAR), ',"method":"minmax"}'), ',' ORDER BY label), '}') AS json FROM state GROUP BY 1
    """,
    T,
)
add("calib_bundle_read", lambda t: sinks.from_bundle(sinks.bundle(_states(t))), STATES + "SELECT head_name, label, p5, p95 FROM state", T)
add(
    "calib_imported",
    lambda t: sinks.imported(_states(t).where("label = 'nom:calm'"), sinks.from_bundle(sinks.bundle(_states(t))), False),
    STATES + "SELECT head_name, label, p5, p95, CASE WHEN label = 'nom:calm' THEN 'skipped' ELSE 'added' END AS status FROM state",
    T,
)
NTH = ", r AS (SELECT *, row_number() OVER (PARTITION BY calibration_key ORDER BY snapshot_at DESC) AS nth FROM snapshots)"
COLS = "calibration_key, snapshot_at, p5, p95, n"
add("calib_history_latest", cal.latest, NTH + f"SELECT {COLS} FROM r WHERE nth = 1", SN)
add("calib_history_prune", lambda s: cal.latest(s, 5), NTH + f"SELECT {COLS} FROM r WHERE nth <= 5", SN)
add("calib_history_key", lambda s: cal.recent(s, 20, "head3"), f"SELECT {COLS} FROM snapshots WHERE calibration_key = 'head3' ORDER BY snapshot_at DESC LIMIT 20", SN)
add("calib_history_recent", lambda s: cal.recent(s, 20, since=100), f"SELECT {COLS} FROM snapshots WHERE snapshot_at >= 100 ORDER BY snapshot_at DESC LIMIT 20", SN)
add(
    "calib_snapshots",
    lambda s: cal.snapshots(s, cal.latest(s).select("calibration_key", (F.col("p5") + 0.01).alias("p5"), "p95", (F.col("n") + 3).alias("n")), 10**9).withColumn("p5", F.round("p5", 6)),
    NTH + "SELECT calibration_key, CAST(1000000000 AS BIGINT) AS snapshot_at, round(p5 + 0.01e0, 6) AS p5, p95, n + 3 AS n, round(p5 + 0.01e0 - p5, 6) AS p5_delta, 0.0e0 AS p95_delta, CAST(3 AS BIGINT) AS n_delta FROM r WHERE nth = 1",
    SN,
)
TERMS = {"energetic": ("energetic", "mellow"), "bright": ("bright", "dark")}


def _stats(g):
    def of(head, c):
        far = F.when(F.col("file_id") % 2 == 0, F.max(c)).when(F.col("file_id") % 3 == 0, F.avg(c)).otherwise(F.min(c))
        return g.groupBy("file_id").agg(F.round(far, 4).alias("mean"), F.round(F.stddev_pop(c) / (F.col("file_id") % 7 + 1), 4).alias("std")).select(F.lit(head).alias("head_name"), "file_id", "mean", "std")

    return of("energetic", "score_a").union(of("bright", "score_b")).union(of("unknown", "score_a"))


STATS = """
, far AS (SELECT file_id, 'energetic' AS head_name, score_a AS x FROM segments UNION ALL SELECT file_id, 'bright', score_b FROM segments),
st AS (SELECT head_name, file_id, round(CASE WHEN file_id % 2 = 0 THEN max(x) WHEN file_id % 3 = 0 THEN avg(x) ELSE min(x) END, 4) AS m, round(stddev_pop(x) / (file_id % 7 + 1), 4) AS s FROM far GROUP BY file_id, head_name),
terms(head_name, hi, lo) AS (VALUES ('energetic', 'energetic', 'mellow'), ('bright', 'bright', 'dark')),
tiered AS (SELECT *, CASE WHEN s >= 0.25 THEN NULL WHEN s < 0.08 AND abs(m - 0.5e0) * 2 >= 0.8 THEN 'high' WHEN s < 0.15 AND abs(m - 0.5e0) * 2 >= 0.6 THEN 'medium' ELSE 'low' END AS tier FROM st JOIN terms USING (head_name)),
outs AS (
  SELECT head_name, file_id, hi AS label, m AS value, CASE WHEN m >= 0.7 THEN tier END AS tier FROM tiered WHERE m > 0.3
  UNION ALL SELECT head_name, file_id, lo, CASE WHEN m <= 0.3 THEN m ELSE 1 - m END, CASE WHEN m <= 0.3 THEN tier END FROM tiered WHERE m < 0.7)
"""
add(
    "regression_outputs",
    lambda g: cal.regression_outputs(_stats(g), TERMS).withColumn("value", F.round("value", 6)),
    STATS + "SELECT head_name, file_id, label, round(value, 6) AS value, tier FROM outs",
    ("segments",),
)
add(
    "mood_tags_of_outputs",
    lambda g: cal.mood_tags(cal.regression_outputs(_stats(g), TERMS).where("tier IS NOT NULL")),
    STATS
    + """
    , lv AS (SELECT file_id, label, CASE tier WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS l FROM outs WHERE tier IS NOT NULL),
    names(rel, i) AS (VALUES ('mood-strict', 0), ('mood-regular', 1), ('mood-loose', 2))
    SELECT file_id, rel, string_agg(DISTINCT label, '|' ORDER BY label) AS moods FROM lv JOIN names ON i >= l GROUP BY 1, 2
    """,
    ("segments",),
)


def _outputs(g):
    """All tiered outputs of four heads; two of them contradict the first two."""
    one = cal.regression_outputs(_stats(g), TERMS)
    two = one.select(F.concat(F.lit("not-"), "head_name").alias("head_name"), "file_id", F.concat(F.lit("un"), "label").alias("label"), (1 - F.col("value")).alias("value"), "tier").where("label IN ('unenergetic', 'undark')")
    return one.union(two).withColumn("model_key", F.concat("head_name", F.lit("/"), "label")).where("tier IS NOT NULL")


def _against(g):
    return g.sparkSession.sql("SELECT * FROM VALUES ('energetic', 'unenergetic'), ('unenergetic', 'energetic'), ('bright', 'mellow'), ('mellow', 'bright') AS t(label, other)")


# greedy by the order of keys: SQL goes through each file's outputs one by one
add("mood_suppression", lambda g: cal.unsuppressed(_outputs(g), _against(g)).withColumn("value", F.round("value", 6)), views=("segments",))
_GREEDY = """
, o AS (
  SELECT head_name, file_id, label, value, tier FROM outs WHERE tier IS NOT NULL
  UNION ALL SELECT concat('not-', head_name), file_id, concat('un', label), 1 - value, tier FROM outs WHERE tier IS NOT NULL AND label IN ('energetic', 'dark')),
k AS (SELECT *, concat(head_name, '/', label) AS model_key FROM o),
best AS (SELECT *, row_number() OVER (PARTITION BY file_id, head_name ORDER BY CASE tier WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, value DESC, model_key) AS nth FROM k),
rows_of AS (SELECT file_id, list({'k': model_key, 'h': head_name, 'l': label} ORDER BY model_key) AS every FROM best WHERE nth = 1 GROUP BY file_id),
step AS (
  SELECT file_id, 0 AS i, CAST([] AS VARCHAR[]) AS gone FROM rows_of
  UNION ALL
  SELECT file_id, i + 1, CASE WHEN list_contains(gone, a.k) OR len(later) = 0 THEN gone ELSE list_concat(list_concat(gone, [a.k]), later) END FROM (
    SELECT s.file_id, i, gone, every[i + 1] AS a, list_transform(list_filter(every, lambda b: b.k > every[i + 1].k AND NOT list_contains(gone, b.k) AND b.h <> every[i + 1].h
      AND list_contains(['energetic|unenergetic', 'unenergetic|energetic', 'bright|mellow', 'mellow|bright'], concat(every[i + 1].l, '|', b.l))), lambda b: b.k) AS later
    FROM step s JOIN rows_of r ON r.file_id = s.file_id WHERE i < len(every))),
final AS (SELECT file_id, max_by(gone, i) AS gone FROM step GROUP BY file_id)
SELECT b.file_id, model_key, head_name, label, round(value, 6) AS value, tier FROM best b JOIN final f ON f.file_id = b.file_id WHERE nth = 1 AND NOT list_contains(gone, model_key)
"""
ORACLE_SQL["mood_suppression"] = with_views("segments").replace("WITH ", "WITH RECURSIVE ", 1) + STATS + _GREEDY
add(
    "model_opponents",
    lambda f: cal.opponents(f.select(F.col("album").alias("model"), F.col("artist").alias("label")).distinct()),
    "SELECT DISTINCT a.artist AS label, b.artist AS other FROM files a JOIN files b USING (album) WHERE a.artist <> b.artist",
    ("files",),
)

# from scores to tags that change: three heads, one of each kind, and two pairs of labels that contradict each other
_HEADS = """
SELECT * FROM VALUES ('energy', 'regression', 'energy', CAST(NULL AS DOUBLE), 'energetic', 'mellow'), ('party', 'multiclass', 'party', 0.6e0, NULL, NULL), ('party', 'multiclass', 'not_party', NULL, NULL, NULL),
  ('mood', 'multilabel', 'happy', NULL, NULL, NULL), ('mood', 'multilabel', 'sad', 0.7e0, NULL, NULL) AS t(head_name, kind, label, threshold, high_term, low_term)
"""
_PAIRS = "SELECT * FROM VALUES ('energetic', 'sad'), ('sad', 'energetic'), ('party', 'mellow'), ('mellow', 'party') AS t(label, other)"


def _segment_figures(g):
    """Per file one figure a label, and a deviation."""
    far = F.when(F.col("file_id") % 2 == 0, F.max("score_a")).when(F.col("file_id") % 3 == 0, F.avg("score_a")).otherwise(F.min("score_a"))
    steady = F.stddev_pop("score_a") / (F.col("file_id") % 7 + 1)
    one = g.groupBy("file_id").agg(F.round(far, 4).alias("energy"), F.round(F.max("score_b"), 4).alias("party"), F.round(1 - F.min("score_b"), 4).alias("not_party"), F.round(F.max("score_a"), 4).alias("happy"), F.round(1 - F.min("score_a") / 2, 4).alias("sad"), F.round(steady, 4).alias("std"))
    head = {"energy": "energy", "party": "party", "not_party": "party", "happy": "mood", "sad": "mood"}
    each = F.array(*(F.struct(F.lit(h).alias("head_name"), F.lit(x).alias("label"), F.col(x).alias("value")) for x, h in head.items()))
    return one.select("file_id", "std", F.inline(each))


def _calibrated_tags(g, states):
    spark, figures = g.sparkSession, _segment_figures(g)
    scores = figures.where("head_name <> 'energy'").select("file_id", "head_name", "label", "value")
    stats = figures.select("file_id", "head_name", "label", F.col("value").alias("mean"), "std")
    known = spark.createDataFrame(states, "label string, p5 double, p95 double")
    return calibrated.calibrated_tags(scores, stats, spark.sql(_HEADS), known, spark.sql(_PAIRS))


def _tags_sql(n: int, states: list) -> str:
    """The CTEs figures, ..., tags with this number, for these states."""
    state = {x: (a, b) for x, a, b in states}

    def scaled(x):
        return f"least(greatest(({x} - {state[x][0]}e0) / ({state[x][1]}e0 - {state[x][0]}e0), 0.0e0), 1.0e0)" if x in state else x

    def span(x):
        return f"std / ({state[x][1]}e0 - {state[x][0]}e0)" if x in state else "std"

    return f"""
, figures{n} AS (
  SELECT file_id, round(CASE WHEN file_id % 2 = 0 THEN max(score_a) WHEN file_id % 3 = 0 THEN avg(score_a) ELSE min(score_a) END, 4) AS energy, round(max(score_b), 4) AS party, round(1 - min(score_b), 4) AS not_party,
    round(max(score_a), 4) AS happy, round(1 - min(score_a) / 2, 4) AS sad, round(stddev_pop(score_a) / (file_id % 7 + 1), 4) AS std FROM segments GROUP BY file_id),
reg{n} AS (SELECT file_id, least(greatest({scaled("energy")}, 0.0e0), 1.0e0) AS m, {span("energy")} AS s FROM figures{n}),
terms{n} AS (
  SELECT file_id, 'energy' AS head, CASE WHEN m >= 0.7 THEN 'energetic' ELSE 'mellow' END AS label,
    CASE WHEN s >= 0.25 THEN NULL WHEN s < 0.08 AND abs(m - 0.5e0) * 2 >= 0.8 THEN 'high' WHEN s < 0.15 AND abs(m - 0.5e0) * 2 >= 0.6 THEN 'medium' ELSE 'low' END AS tier
  FROM reg{n} WHERE m >= 0.7 OR m <= 0.3),
cls{n} AS (
  SELECT file_id, 'party' AS head, 'party' AS label, 0.6e0 AS least, {scaled("party")} AS p, {scaled("not_party")} AS c, {span("party")} AS s FROM figures{n}
  UNION ALL SELECT file_id, 'party', 'not_party', 0.6e0, {scaled("not_party")}, {scaled("party")}, {span("not_party")} FROM figures{n}
  UNION ALL SELECT file_id, 'mood', 'happy', 0.6e0, {scaled("happy")}, {scaled("sad")}, {span("happy")} FROM figures{n}
  UNION ALL SELECT file_id, 'mood', 'sad', 0.7e0, {scaled("sad")}, {scaled("happy")}, {span("sad")} FROM figures{n}),
found{n} AS (
  SELECT file_id, head, label, CASE WHEN p >= 0.8 AND q >= 1.2 AND p - k >= 0.15 AND s < 0.08 THEN 'high' WHEN p >= 0.75 AND q >= 1.1 AND p - k >= 0.08 AND s < 0.15 THEN 'medium' WHEN p >= 0.6 AND q >= 1.02 AND p - k >= 0.03 AND s < 0.25 THEN 'low' END AS tier
  FROM (SELECT *, least(greatest(c, 0), 1) AS k, p / greatest(least(greatest(c, 0), 1), 1e-9) AS q FROM cls{n}) WHERE p >= least
  UNION ALL SELECT file_id, head, label, tier FROM terms{n}),
tiered{n} AS (SELECT * FROM found{n} WHERE tier IS NOT NULL),
stay{n} AS (
  SELECT * FROM tiered{n} t WHERE NOT EXISTS (
    SELECT 1 FROM tiered{n} o JOIN (VALUES ('energetic', 'sad'), ('sad', 'energetic'), ('party', 'mellow'), ('mellow', 'party')) AS v(label, other) ON v.label = t.label AND v.other = o.label
    WHERE o.file_id = t.file_id AND o.head <> t.head)),
tags{n} AS (
  SELECT file_id, rel, string_agg(DISTINCT label, '|' ORDER BY label) AS moods
  FROM (SELECT file_id, label, CASE tier WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS l FROM stay{n}) JOIN (VALUES ('mood-strict', 0), ('mood-regular', 1), ('mood-loose', 2)) AS names(rel, i) ON i >= l GROUP BY 1, 2)"""


_BEFORE, _AFTER = [("happy", 0.0, 0.9)], [("energy", 0.05, 0.95), ("happy", 0.1, 0.9), ("sad", 0.2, 1.0)]


def _changed_tags(g):
    files = g.select("file_id").distinct()
    stored = calibrated.content_hash(_calibrated_tags(g, _BEFORE), files)
    return calibrated.changed(_calibrated_tags(g, _AFTER), files, stored)


_HASHES = """
, hashes AS (
  SELECT f.file_id, md5(coalesce((SELECT string_agg(concat(rel, '=', moods), chr(10) ORDER BY concat(rel, '=', moods)) FROM tags0 t WHERE t.file_id = f.file_id), '')) AS was,
    md5(coalesce((SELECT string_agg(concat(rel, '=', moods), chr(10) ORDER BY concat(rel, '=', moods)) FROM tags1 t WHERE t.file_id = f.file_id), '')) AS content_hash
  FROM (SELECT DISTINCT file_id FROM segments) f)
"""
add("calibrated_tags", lambda g: _calibrated_tags(g, _AFTER), _tags_sql(1, _AFTER) + " SELECT file_id, rel, moods FROM tags1", ("segments",))
add(
    "calibrated_tags_changed",
    lambda g: _changed_tags(g)[0],
    _tags_sql(0, _BEFORE) + _tags_sql(1, _AFTER) + _HASHES + "SELECT file_id, content_hash FROM hashes WHERE was <> content_hash",
    ("segments",),
)
add(
    "calibrated_tags_to_write",
    lambda g: _changed_tags(g)[1],
    _tags_sql(0, _BEFORE) + _tags_sql(1, _AFTER) + _HASHES + "SELECT file_id, rel, moods FROM tags1 WHERE file_id IN (SELECT file_id FROM hashes WHERE was <> content_hash)",
    ("segments",),
)
