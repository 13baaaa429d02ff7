"""Names and texts of tags, containers' raw tags, matching, and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, texts
from ..operators import matching, normalise, sinks
from .registry import add

#: A few versioned and plain keys for each file: what the queries below name and parse.
RELS = """
, rels AS (SELECT DISTINCT rel, value_num IS NOT NULL AS numeric FROM tags_long
  UNION SELECT DISTINCT concat('nom:', lower(replace(album, ' ', '_')), '_essentia21-beta6-dev_musicnn20200331_', lower(replace(album, ' ', '_')), '20220825'), true FROM files
  UNION SELECT DISTINCT concat('nom:effnet_', lower(artist)), false FROM files)
"""


def _rels(t, f):
    album = F.lower(F.replace("album", F.lit(" "), F.lit("_")))
    versioned = F.concat(F.lit("nom:"), album, F.lit("_essentia21-beta6-dev_musicnn20200331_"), album, F.lit("20220825"))
    plain = t.select("rel", F.col("value_num").isNotNull().alias("numeric"))
    return plain.union(f.select(versioned, F.lit(True))).union(f.select(F.concat(F.lit("nom:effnet_"), F.lower("artist")), F.lit(False))).distinct()


TF = ("tags_long", "files")
#: Fixed value: the form of a versioned key.
VERSIONED = r"^([a-z_]+)_essentia[\w.-]+_[a-z]+\d+_[a-z_]+\d+$"
add(
    "key_names",
    lambda t, f: _rels(t, f).select("rel", keys.is_versioned(F.col("rel")).alias("versioned"), keys.label_of(F.col("rel")).alias("label"), keys.short_name(F.col("rel"), F.col("numeric")).alias("short_name"), keys.field_name(keys.short_name(F.col("rel"), F.col("numeric"))).alias("field")),
    RELS
    + rf"""
    , k AS (SELECT rel, numeric, regexp_replace(rel, '^nom:', '') AS key FROM rels),
    v AS (SELECT *, regexp_matches(key, '{VERSIONED}', 'i') AS versioned, nullif(regexp_extract(key, '{VERSIONED}', 1, 'i'), '') AS label FROM k),
    s AS (SELECT *, concat('nom-', CASE WHEN versioned AND NOT regexp_matches(key, '^(mood-strict|mood-regular|mood-loose|effnet_|nom_version)')
      THEN concat(replace(label, '_', '-'), CASE WHEN numeric THEN '-raw' ELSE '' END) ELSE replace(key, '_', '-') END) AS short_name FROM v)
    SELECT rel, versioned, label, short_name, replace(short_name, '-', '_') AS field FROM s
    """,
    TF,
)
add(
    "key_parts",
    lambda t, f: _rels(t, f).select("rel", keys.parts_of(F.col("rel")).alias("p")).select("rel", "p.label", "p.framework", "p.head"),
    RELS + "SELECT rel, " + ", ".join(f"CASE WHEN len(string_split(rel, '_')) >= 3 THEN string_split(rel, '_')[{i}] END AS {n}" for n, i in (("label", 1), ("framework", 2), ("head", -1))) + " FROM rels",
    TF,
)
add(
    "key_hashes",
    lambda f: f.select("file_id", keys.definition_hash(F.col("artist"), F.col("album"), F.col("title")).alias("hash"), keys.state_key(F.col("artist"), F.col("title")).alias("state_key"), keys.plain_label(F.when(F.col("library_id") == 1, F.concat(F.lit("non_"), "title")).otherwise(F.col("title"))).alias("label")),
    """
    SELECT file_id, md5(concat(artist, ':', album, ':', title)) AS hash, replace(replace(concat(artist, ':', title), '#', '_'), ' ', '_') AS state_key,
      CASE WHEN library_id = 1 THEN concat('not_', title) ELSE title END AS label FROM files
    """,
    ("files",),
)
add(
    "values_multi",
    lambda f: f.select("file_id", F.array_join(texts.multi_values(F.when(F.col("library_id") == 0, F.concat(F.lit('["'), "title", F.lit('; x","'), "album", F.lit('",""]'))).when(F.col("library_id") == 1, F.concat("title", F.lit(" ;; "), "album")).when(F.col("library_id") == 2, F.col("title"))), "|").alias("v")),
    """
    SELECT file_id, CASE library_id WHEN 0 THEN concat(title, '|x|', album) WHEN 1 THEN concat(title, '|', album) WHEN 2 THEN title ELSE '' END AS v FROM files
    """,
    ("files",),
)
add(
    "values_typed",
    lambda f: f.select("file_id", F.explode(texts.typed_values(F.when(F.col("library_id") == 0, F.concat(F.lit('["'), "title", F.lit('","12"]'))).when(F.col("library_id") == 1, F.col("file_size").cast("string")).when(F.col("library_id") == 2, F.concat(F.lit("('"), "title", F.lit("', '7')"))).when(F.col("library_id") == 3, F.concat("title", F.lit("; 5"))).otherwise(F.col("title")))).alias("v")).select("file_id", "v.value_str", "v.value_num"),
    """
    SELECT file_id, CASE WHEN library_id <> 1 THEN title END AS value_str, CASE WHEN library_id = 1 THEN CAST(file_size AS DOUBLE) END AS value_num FROM files
    UNION ALL SELECT file_id, CASE library_id WHEN 2 THEN '7' WHEN 3 THEN '5' END, CASE WHEN library_id = 0 THEN 12.0e0 END FROM files WHERE library_id IN (0, 2, 3)
    """,
    ("files",),
)
add(
    "played_ms",
    lambda p: p.select("user_id", "nd_id", texts.played_ms(F.when(F.col("nd_id") % 4 == 0, F.lit("never")).when(F.col("nd_id") % 4 == 1, F.date_format("last_played", "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).otherwise(F.date_format("last_played", "yyyy-MM-dd'T'HH:mm:ss"))).alias("ms")),
    "SELECT user_id, nd_id, CASE nd_id % 4 WHEN 0 THEN 0 WHEN 1 THEN epoch_ms(last_played) - 7200000 ELSE epoch_ms(last_played) END AS ms FROM plays",
    ("plays",),
)
#: Each file's raw tags in one container's spelling: the container's, and the keys under which title, artist, genres, date and noise stand.
SPELLING = [("mp4", "\xa9nam", "\xa9ART", "\xa9gen", "\xa9day", "covr"), ("id3", "TIT2", "TPE1", "TCON", "TDRC", "APIC:"), ("vorbis", "title", "Artist", "GENRE", "DATE", "COVERART")]


def _raw(f):
    spelling = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(s, ("container", "title_key", "artist_key", "genre_key", "date_key", "noise_key"), strict=True))) for s in SPELLING))
    own = f.withColumn("s", F.get(spelling, (F.col("library_id") % 3).cast("int")))
    tag = lambda pos, key, *values: F.struct(F.lit(pos).alias("pos"), F.col(f"s.{key}").alias("key"), F.array(*values).alias("values"))
    rows = F.array(tag(1, "title_key", F.lit("old")), tag(2, "title_key", F.col("title")), tag(3, "artist_key", F.concat("artist", F.lit("; "), "album")), tag(4, "genre_key", F.concat("album", F.lit(";b"))), tag(5, "date_key", F.lit("1999-05-01")), tag(6, "noise_key", F.lit("x")))
    return own.select("file_id", "s.container", F.inline(rows))


RAW = """
, kept AS (
  SELECT file_id, 'title' AS key, title AS v FROM files UNION ALL SELECT file_id, 'artist', concat(artist, '; ', album) FROM files
  UNION ALL SELECT file_id, 'genre', concat(album, ';b') FROM files UNION ALL SELECT file_id, 'date', '1999-05-01' FROM files)
"""
add("tags_normalised", lambda f: normalise.normalised(_raw(f)).select("file_id", "key", F.array_join("values", "|").alias("v")), RAW + "SELECT * FROM kept", ("files",))
ENTITY = """
, ent AS (
  SELECT file_id, 'artist' AS rel, artist AS value FROM files UNION ALL SELECT file_id, 'artists', artist FROM files
  UNION ALL SELECT file_id, 'genre', album FROM files UNION ALL SELECT file_id, 'genre', 'b' FROM files UNION ALL SELECT file_id, 'year', '1999' FROM files)
"""
add("tags_seeded", lambda f: normalise.entity_tags(normalise.normalised(_raw(f))), ENTITY + "SELECT * FROM ent", ("files",))
add(
    "file_cache_fields",
    lambda f: normalise.cache_fields(normalise.entity_tags(normalise.normalised(_raw(f)))).select("file_id", "artist", "album", F.array_join("genres", "|").alias("genres"), F.array_join("labels", "|").alias("labels"), "year"),
    "SELECT file_id, artist, CAST(NULL AS VARCHAR) AS album, CASE WHEN album < 'b' THEN concat(album, '|b') ELSE concat('b|', album) END AS genres, '' AS labels, CAST(1999 AS INTEGER) AS year FROM files",
    ("files",),
)


def _asked(f):
    """Playlist tracks made of the library: as it is, with a version, or with a letter lost in title and artist."""
    dropped = lambda c: F.concat(F.substring(c, 1, 3), F.substring(c, 5, 100))
    kind = F.col("library_id")
    title = F.when(kind == 1, F.concat(F.upper("title"), F.lit(" (Remastered 2011)"))).when(kind == 2, dropped("title")).otherwise(F.col("title"))
    artist = F.when(kind == 3, F.concat(F.lit("The "), "artist")).when(kind == 4, F.concat(F.col("artist"), F.lit(" feat. Nobody"))).otherwise(F.col("artist"))
    return f.select(F.col("file_id").alias("track_id"), F.when(kind == 0, F.concat(F.lit("ISRC"), F.col("file_id").cast("string"))).alias("isrc"), title.alias("title"), artist.alias("artist"))


def _library(f):
    return f.select("file_id", F.concat(F.lit("ISRC"), F.col("file_id").cast("string")).alias("isrc"), "title", "artist")


add(
    "match_normalised",
    lambda f: matching.match(_asked(f), _library(f)).where("status <> 'not_found'"),
    """
    , first AS (SELECT title, artist, min(file_id) AS file_id FROM files GROUP BY 1, 2)
    SELECT f.file_id AS track_id, CASE library_id WHEN 0 THEN 'isrc' ELSE 'exact' END AS status, CASE library_id WHEN 0 THEN f.file_id ELSE first.file_id END AS file_id
    FROM files f JOIN first ON first.title = f.title AND first.artist = f.artist WHERE library_id <> 2
    """,
    ("files",),
)
# likeness of texts has no SQL here; tests compare it with all pairs
add("match_fuzzy", lambda f: matching.fuzzy(_asked(f), _library(f)), views=("files",))
add("match_status_counts", lambda f: matching.status_counts(matching.match_all(_asked(f), _library(f))), views=("files",))

add(
    "m3u_document",
    lambda f: sinks.m3u(sinks.m3u_lines(f.withColumn("artist", F.when(F.col("library_id") != 3, F.col("artist"))).withColumn("title", F.when(F.col("library_id") != 2, F.col("title"))), f.select("file_id", (-F.col("file_id")).alias("nth")), "/music/"), "All"),
    r"""
    SELECT concat('#EXTM3U', chr(10), '#PLAYLIST:All', chr(10), string_agg(concat('#EXTINF:', CAST(CAST(floor(duration_seconds) AS BIGINT) AS VARCHAR), ',', CASE WHEN library_id <> 3 THEN artist ELSE 'Unknown Artist' END, ' - ',
      CASE WHEN library_id <> 2 THEN title ELSE concat(CAST(file_id AS VARCHAR), '.flac') END, chr(10), '/music/', normalized_path), chr(10) ORDER BY file_id DESC)) AS text FROM files
    """,
    ("files",),
)
add(
    "config_fields",
    lambda t, f: sinks.config_fields(_rels(t, f).where("rel LIKE 'nom:mood%'")),
    "SELECT DISTINCT rel, concat('nom-', substr(rel, 5)) AS short_name, replace(concat('nom_', substr(rel, 5)), '-', '_') AS field, 'string' AS kind, concat(rel, ',', upper(replace(replace(rel, ':', '_'), '-', '_')), ',', replace(replace(rel, ':', '_'), '-', '_')) AS aliases FROM tags_long WHERE rel LIKE 'nom:mood%'",
    TF,
)
add(
    "config_toml",
    lambda t, f: sinks.toml(sinks.config_fields(_rels(t, f).where("rel LIKE 'nom:mood%'"))),
    """
    , k AS (SELECT DISTINCT rel, replace(replace(rel, ':', '_'), '-', '_') AS plain FROM tags_long WHERE rel LIKE 'nom:mood%')
    SELECT plain AS field, concat('[Tags.', plain, ']', chr(10), 'Aliases = ["', rel, '", "', upper(plain), '", "', plain, '"]', chr(10), 'Type = "string"') AS text FROM k
    """,
    TF,
)


def _shared(f, at, every):
    """Files of which several share a fingerprint, all under paths below `at`."""
    return f.select("file_id", F.concat(F.lit(at), "normalized_path").alias("path"), F.concat_ws(":", "title", "album", (F.col("file_id") % every).cast("string")).alias("fingerprint"), F.col("duration_seconds").alias("duration"))


add(
    "file_move_collisions",
    lambda f: matching.collisions(_shared(f, "old/", 2), _shared(f, "new/", 2)),
    "SELECT concat(title, ':', album, ':', CAST(file_id % 2 AS VARCHAR)) AS fingerprint, count(*) AS n_removed, count(*) AS n_new FROM files GROUP BY 1 HAVING count(*) > 1",
    ("files",),
)
