"""Taste weights, centroids and playlists near them. `now` is fixed, so that results are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import personal
from .registry import add

NOW = "2001-09-01 12:00:00"
N = 20
DAYS = f"(epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(last_played)) / 86400000.0e0"
WEIGHT = f"ln(1 + playcount) * exp(-ln(2.0e0) / 30.0e0 * ({DAYS}))"
DIMS = "CROSS JOIN (SELECT CAST(unnest(range(1, 65)) AS INTEGER) AS i)"
#: The busiest user's plays, the taste of it, and all tracks by their distance to it.
TASTE = f"""
, busy AS (SELECT user_id FROM plays GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1),
own AS (SELECT * FROM plays WHERE user_id = (SELECT user_id FROM busy)),
tops AS (SELECT *, {WEIGHT} AS weight FROM (SELECT * FROM own ORDER BY playcount DESC, nd_id LIMIT 200)),
sums AS (SELECT i, sum(weight * CAST(vector[i] AS DOUBLE)) AS s, count(*) AS track_count FROM tops JOIN vectors ON nd_id = file_id {DIMS} GROUP BY i),
taste AS (SELECT list(s / (SELECT sqrt(sum(s * s)) FROM sums) ORDER BY i) AS q, max(track_count) AS track_count FROM sums),
unit AS (SELECT file_id, CAST(vector AS DOUBLE[]) AS v FROM vectors),
scored AS (SELECT file_id, round(list_dot_product(v, q) / sqrt(list_dot_product(v, v)), 6) AS score FROM unit, taste),
near AS (SELECT *, row_number() OVER (ORDER BY score DESC, file_id) AS rank FROM scored),
played AS (SELECT nd_id AS file_id FROM own)
"""
PV = ("plays", "vectors")
PVT = (*PV, "tags_long")


def _taste(p, v):
    own = personal.busiest(p)
    return own, personal.profile(own, v, NOW)


add(
    "taste_weights",
    lambda p: personal.taste_weights(p, NOW).withColumn("weight", F.round("weight", 6)),
    f"SELECT user_id, nd_id, round({WEIGHT}, 6) AS weight FROM plays",
    ("plays",),
)
add(
    "taste_centroid",
    lambda p, v: personal.taste_centroids(personal.taste_weights(p, NOW), v).withColumn("value", F.round("value", 5) + 0.0),
    f"""
    , s AS (SELECT user_id, i - 1 AS dim, sum({WEIGHT} * CAST(vector[i] AS DOUBLE)) AS s FROM plays JOIN vectors ON nd_id = file_id {DIMS} GROUP BY 1, 2),
    l AS (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY user_id)) AS len FROM s)
    SELECT user_id, dim, CASE WHEN len > 0 THEN round(s / len, 5) ELSE 0.0e0 END + 0.0e0 AS value FROM l
    """,
    PV,
)
add(
    "taste_profile",
    lambda p, v: _taste(p, v)[1].select("track_count", F.posexplode(F.transform("q", lambda x: F.round(x, 5) + 0.0)).alias("dim", "value")),
    TASTE + "SELECT track_count, CAST(i - 1 AS INTEGER) AS dim, round(q[i], 5) + 0.0e0 AS value FROM taste " + DIMS,
    PV,
)
add(
    "pl_familiar",
    lambda p, v: personal.familiar(*_taste(p, v), v, N),
    TASTE + f"SELECT file_id, score, rank FROM near WHERE rank <= {5 * N} AND file_id IN (SELECT file_id FROM played) ORDER BY rank LIMIT {N}",
    PV,
)
add(
    "pl_discovery",
    lambda p, v: personal.discovery(*_taste(p, v), v, N),
    TASTE + f"SELECT file_id, score, rank FROM near WHERE rank <= {2 * N} AND file_id NOT IN (SELECT file_id FROM played) ORDER BY rank LIMIT {N}",
    PV,
)
GEMS = """
, known AS (SELECT DISTINCT value_str FROM tags_long WHERE rel = 'artist' AND file_id IN (SELECT file_id FROM played)),
heard AS (SELECT file_id FROM tags_long WHERE rel = 'artist' AND value_str IN (SELECT value_str FROM known))
"""
add(
    "pl_hidden_gems",
    lambda p, v, t: personal.hidden_gems(*_taste(p, v), v, t, N),
    TASTE + GEMS + f"SELECT file_id, score, rank FROM near WHERE rank <= {3 * N} AND file_id NOT IN (SELECT file_id FROM played) AND file_id NOT IN (SELECT file_id FROM heard) ORDER BY rank LIMIT {N}",
    PVT,
)
add(
    "pl_universal",
    lambda p, v: personal.universal(_taste(p, v)[1], v, N),
    TASTE + f"SELECT file_id, score, rank FROM near WHERE rank <= {3 * N} AND (rank - 1) % greatest(1, (SELECT least(count(*), {3 * N}) // {N} FROM near)) = 0 ORDER BY rank LIMIT {N}",
    PV,
)
add(
    "pl_genre",
    lambda p, v, t: personal.genre_playlists(personal.busiest(p), v, t, NOW, N, 5, 15),
    TASTE
    + f"""
    , genres AS (SELECT DISTINCT file_id, value_str AS genre FROM tags_long WHERE rel = 'genre'),
    weighted AS (SELECT genre, {WEIGHT} AS weight, v.vector FROM own JOIN vectors v ON nd_id = v.file_id JOIN genres g ON g.file_id = nd_id),
    tops5 AS (SELECT genre FROM weighted GROUP BY genre ORDER BY round(sum(weight), 9) DESC, genre LIMIT 5),
    gs AS (SELECT genre, i, sum(weight * CAST(vector[i] AS DOUBLE)) AS s FROM weighted {DIMS} WHERE genre IN (SELECT genre FROM tops5) GROUP BY genre, i),
    gq AS (SELECT genre, list(s ORDER BY i) AS q FROM gs GROUP BY genre),
    gscored AS (SELECT gq.genre, u.file_id, round(list_dot_product(v, q) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(q, q)), 6) AS score FROM gq JOIN genres g ON g.genre = gq.genre JOIN unit u ON u.file_id = g.file_id),
    gnear AS (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY score DESC, file_id) AS rank FROM gscored)
    SELECT genre, file_id, score, rank FROM gnear WHERE rank <= {N} AND genre IN (SELECT genre FROM gnear WHERE rank <= {3 * N} GROUP BY genre HAVING count(*) >= 15)
    """,
    PVT,
)
add(
    "pl_all",
    lambda p, v, t: personal.playlists(personal.busiest(p), v, t, NOW, N, 10),
    TASTE
    + GEMS
    + f"""
    , lists AS (
      SELECT 'familiar' AS playlist, file_id, rank, row_number() OVER (ORDER BY rank) AS nth FROM near WHERE rank <= {5 * N} AND file_id IN (SELECT file_id FROM played)
      UNION ALL SELECT 'discovery', file_id, rank, row_number() OVER (ORDER BY rank) FROM near WHERE rank <= {2 * N} AND file_id NOT IN (SELECT file_id FROM played)
      UNION ALL SELECT 'hidden_gems', file_id, rank, row_number() OVER (ORDER BY rank) FROM near WHERE rank <= {3 * N} AND file_id NOT IN (SELECT file_id FROM played) AND file_id NOT IN (SELECT file_id FROM heard)
      UNION ALL SELECT 'universal', file_id, rank, row_number() OVER (ORDER BY rank) FROM near WHERE rank <= {3 * N} AND (rank - 1) % greatest(1, (SELECT least(count(*), {3 * N}) // {N} FROM near)) = 0),
    cut AS (SELECT *, count(*) OVER (PARTITION BY playlist) AS size FROM lists WHERE nth <= {N})
    SELECT playlist, file_id, rank FROM cut WHERE size >= 10
    """,
    PVT,
)
