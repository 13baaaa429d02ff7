"""File states: selections, counts, transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import states
from .registry import add

FS = ("files", "states")
HEADS = [("energy-head", ["energy"], "energy"), ("mood-head", ["mood-strict", "mood-loose"], "mood"), ("calm-head", ["calm", "relaxed"], "calm"), ("dance-head", ["danceable"], "dance")]

add(
    "states_discover_next",
    lambda f, s, c: states.waiting(f, s, c).orderBy("file_id").limit(1).select("file_id", "library_id", "normalized_path"),
    """
    SELECT file_id, library_id, normalized_path FROM files f
    WHERE EXISTS (SELECT 1 FROM states s WHERE s.file_id = f.file_id AND axis = 'tagged' AND NOT positive)
      AND NOT EXISTS (SELECT 1 FROM states s WHERE s.file_id = f.file_id AND axis IN ('too_short', 'errored') AND positive)
      AND file_id NOT IN (SELECT file_id FROM claims)
    ORDER BY file_id LIMIT 1
    """,
    (*FS, "claims"),
)
add(
    "states_waiting",
    lambda f, s, c: states.waiting(f, s, c).select("file_id", "library_id"),
    """
    SELECT file_id, library_id FROM files f
    WHERE (SELECT NOT positive FROM states s WHERE s.file_id = f.file_id AND axis = 'tagged')
      AND NOT (SELECT positive FROM states s WHERE s.file_id = f.file_id AND axis = 'too_short')
      AND NOT (SELECT positive FROM states s WHERE s.file_id = f.file_id AND axis = 'errored')
      AND NOT EXISTS (SELECT 1 FROM claims c WHERE c.file_id = f.file_id)
    """,
    (*FS, "claims"),
)
add(
    "states_untagged_ids",
    lambda f, s: f.where("library_id = 2").join(states.in_state(s, "tagged", False), "file_id", "left_semi").orderBy("file_id").limit(100).select("file_id"),
    "SELECT file_id FROM files JOIN states USING (file_id) WHERE axis = 'tagged' AND NOT positive AND library_id = 2 ORDER BY file_id LIMIT 100",
    FS,
)
add(
    "states_tagged_paths",
    lambda f, s: f.join(states.in_state(s, "tagged"), "file_id", "left_semi").select("normalized_path"),
    "SELECT normalized_path FROM files JOIN states USING (file_id) WHERE axis = 'tagged' AND positive",
    FS,
)
add(
    "states_uncalibrated_tagged",
    lambda s: states.both_states(s, ("tagged", True), ("calibrated", False)),
    "SELECT file_id FROM states WHERE axis = 'tagged' AND positive INTERSECT SELECT file_id FROM states WHERE axis = 'calibrated' AND NOT positive",
    ("states",),
)
add(
    "states_by_library",
    lambda f, s: states.counts(f, s, "calibrated"),
    """
    SELECT library_id, count(*) FILTER (WHERE positive) AS n_positive, count(*) FILTER (WHERE NOT positive) AS n_negative
    FROM files JOIN states USING (file_id) WHERE axis = 'calibrated' GROUP BY library_id
    """,
    FS,
)
for name, axis in (("untagged", "tagged"), ("errored", "errored"), ("pending_writes", "tags_written"), ("uncalibrated", "calibrated")):
    side = "n_positive" if name == "errored" else "n_negative"
    add(
        f"states_count_{name}",
        lambda f, s, axis=axis, side=side: states.counts(f, s, axis).select("library_id", F.col(side).alias("n_files")),
        f"SELECT library_id, count(*) FILTER (WHERE {'positive' if name == 'errored' else 'NOT positive'}) AS n_files FROM files JOIN states USING (file_id) WHERE axis = '{axis}' GROUP BY library_id",
        FS,
    )
add(
    "states_all_counts",
    states.all_counts,
    "SELECT axis, CAST(sum(CASE WHEN positive THEN 1 ELSE 0 END) AS BIGINT) AS n_positive, CAST(sum(CASE WHEN positive THEN 0 ELSE 1 END) AS BIGINT) AS n_negative FROM states GROUP BY axis",
    ("states",),
)
add(
    "states_initialised",
    lambda f, s: states.initialised(s.where("axis <> 'errored'"), f),
    "SELECT file_id, axis, CASE WHEN axis = 'errored' THEN false ELSE positive END AS positive FROM states",
    FS,
)
add(
    "states_tags_stale",
    lambda f, s: states.moved(s, "tags_current", False, f.where("library_id = 1")),
    """
    SELECT s.file_id, axis, CASE WHEN axis = 'tags_current' AND library_id = 1 THEN false ELSE positive END AS positive
    FROM states s JOIN files USING (file_id)
    """,
    FS,
)
add(
    "states_scanned",
    lambda s: states.moved(s, "scanned", True),
    "SELECT file_id, axis, axis = 'scanned' OR positive AS positive FROM states",
    ("states",),
)
add(
    "states_cleared_tagged",
    lambda f, s: states.cleared(s, "tagged", f.where("album = 'STANDARD' OR library_id = 3")),
    """
    SELECT s.file_id, axis, CASE WHEN axis = 'tagged' AND (album = 'STANDARD' OR library_id = 3) THEN false ELSE positive END AS positive
    FROM states s JOIN files USING (file_id)
    """,
    FS,
)
add(
    "states_transitioned",
    lambda s, c: states.transitioned(s, c.select("file_id", F.lit("errored").alias("axis"), (F.col("worker_id") % 2 == 0).alias("positive"), F.col("worker_id").alias("at"))),
    """
    , last AS (SELECT file_id, max(worker_id) AS latest FROM claims GROUP BY file_id)
    SELECT s.file_id, axis, CASE WHEN axis = 'errored' AND latest IS NOT NULL THEN latest % 2 = 0 ELSE positive END AS positive
    FROM states s LEFT JOIN last USING (file_id)
    """,
    ("states", "claims"),
)
add(
    "states_outdated",
    states.outdated,
    """
    SELECT library_id, name, count(*) AS n_outdated FROM files JOIN libraries USING (library_id)
    WHERE file_write_mode <> 'none' AND file_id IN (SELECT file_id FROM states WHERE axis IN ('tags_current', 'tags_written') AND NOT positive)
    GROUP BY library_id, name
    """,
    (*FS, "libraries"),
)
_HEADS = ", ".join(f"('{key}', [{', '.join(map(repr, labels))}], '{model}')" for key, labels, model in HEADS)
_COVERAGE = f"""
, expected(head, labels, model) AS (VALUES {_HEADS}),
tagged AS (SELECT file_id, library_id FROM files JOIN states USING (file_id) WHERE axis = 'tagged' AND positive),
matched AS (
  SELECT DISTINCT t.file_id, e.head FROM tagged t JOIN tags_long g USING (file_id)
  JOIN expected e ON starts_with(g.rel, 'nom:') AND list_contains(e.labels, split_part(substr(g.rel, 5), '_', 1)) AND contains(substr(g.rel, 5), e.model)),
lacks AS (SELECT t.file_id, t.library_id, e.head, m.head IS NULL AS missing FROM tagged t CROSS JOIN expected e LEFT JOIN matched m ON m.file_id = t.file_id AND m.head = e.head)
"""
add(
    "states_head_coverage",
    lambda f, s, t: states.head_coverage(f, t, s, HEADS),
    _COVERAGE
    + """
    SELECT file_id, library_id, count(*) FILTER (WHERE NOT missing) AS matched_count, count(*) FILTER (WHERE missing) AS missing_count,
      coalesce(string_agg(head, ',' ORDER BY head) FILTER (WHERE missing), '') AS missing_heads
    FROM lacks GROUP BY file_id, library_id
    """,
    (*FS, "tags_long"),
)
add(
    "states_missing_heads",
    lambda f, s, t: states.missing_histogram(states.head_coverage(f, t, s, HEADS)),
    _COVERAGE + "SELECT head, count(*) AS n_files FROM lacks WHERE missing GROUP BY head",
    (*FS, "tags_long"),
)
add(
    "states_healed_short",
    lambda f, s: states.healed_short(f, s, 100.0),
    """
    SELECT file_id, 'too_short' AS axis, duration_seconds < 100 AS positive FROM files JOIN states USING (file_id)
    WHERE axis = 'too_short' AND (duration_seconds < 100) <> positive
    """,
    FS,
)
