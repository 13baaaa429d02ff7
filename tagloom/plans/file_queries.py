"""Selections of files and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import files as fl
from ..operators import states
from .registry import add

FT = ("files", "tags_long")
joined = lambda c: F.array_join(F.transform(c, lambda t: F.concat(t["key"], F.lit("="), t["value"], F.lit(":"), t["type"])), "|")
NESTED = """
, flat AS (SELECT file_id, concat(rel, '=', coalesce(value_str, CAST(value_num AS VARCHAR)), CASE WHEN value_str IS NULL THEN ':float' ELSE ':string' END) AS t, rel, coalesce(value_str, CAST(value_num AS VARCHAR)) AS v FROM tags_long),
nested AS (SELECT file_id, string_agg(t, '|' ORDER BY rel, v) AS tags FROM flat GROUP BY file_id)
"""


def specs(t, *pairs):
    """A few (rel, value) pairs as a table."""
    return t.sparkSession.createDataFrame(list(pairs), "rel string, value string")


add(
    "files_with_tags",
    lambda f, t: fl.with_tags(f, t).select("file_id", "title", joined("tags").alias("tags")),
    NESTED + "SELECT f.file_id, title, coalesce(tags, '') AS tags FROM files f LEFT JOIN nested n ON n.file_id = f.file_id",
    FT,
)
add(
    "files_search_full",
    lambda f, t, s: fl.with_tags(fl.search(f, t, states.in_state(s, "tagged"), "IN", tag_key="nom:mood-loose", tag_value="1-URGENT", tagged_only=True).orderBy("artist", "album", "title", "file_id").limit(20), t).select("file_id", "artist", "album", "title", joined("tags").alias("tags")),
    NESTED
    + """
    SELECT f.file_id, artist, album, title, tags FROM files f JOIN nested n ON n.file_id = f.file_id
    WHERE (lower(artist) LIKE '%in%' OR lower(album) LIKE '%in%' OR lower(title) LIKE '%in%')
      AND f.file_id IN (SELECT file_id FROM tags_long WHERE rel = 'nom:mood-loose' AND value_str = '1-URGENT')
      AND f.file_id IN (SELECT file_id FROM states WHERE axis = 'tagged' AND positive)
    ORDER BY artist, album, title, f.file_id LIMIT 20
    """,
    (*FT, "states"),
)
add(
    "files_search_total",
    lambda f, t, s: fl.search(f, t, states.in_state(s, "tagged"), tag_key="genre", tagged_only=True).agg(F.count("*").alias("total")),
    "SELECT count(*) AS total FROM files WHERE file_id IN (SELECT file_id FROM tags_long WHERE rel = 'genre') AND file_id IN (SELECT file_id FROM states WHERE axis = 'tagged' AND positive)",
    (*FT, "states"),
)
add(
    "files_by_tag_exact",
    lambda f, t: fl.with_tags(f.join(fl.songs_of_tag(t, "genre", "ring"), "file_id", "left_semi"), t).select("file_id", joined("tags").alias("tags")),
    NESTED + "SELECT file_id, tags FROM nested WHERE file_id IN (SELECT file_id FROM tags_long WHERE rel = 'genre' AND value_str = 'ring')",
    FT,
)
add(
    "files_page",
    lambda f: fl.page(f, 5, 10, library=2)[0].select("file_id", "artist", "album", "title"),
    "SELECT file_id, artist, album, title FROM files WHERE library_id = 2 ORDER BY artist, album, title, file_id LIMIT 10 OFFSET 5",
    ("files",),
)
add("files_page_total", lambda f: fl.page(f, 5, 10, artist="Brand#13")[1], "SELECT count(*) AS total FROM files WHERE artist = 'Brand#13'", ("files",))
add(
    "files_by_path",
    lambda f: fl.by_path(f.withColumn("path", F.concat(F.lit("/music/"), "normalized_path")), f.select(F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("/music/"), "normalized_path")).when(F.col("file_id") % 3 == 1, F.col("normalized_path")).otherwise(F.concat(F.lit("x"), "normalized_path")).alias("path"))),
    """
    SELECT CASE file_id % 3 WHEN 0 THEN concat('/music/', normalized_path) WHEN 1 THEN normalized_path ELSE concat('x', normalized_path) END AS path,
      CASE WHEN file_id % 3 < 2 THEN file_id END AS file_id FROM files
    """,
    ("files",),
)
add(
    "files_path_prefix",
    lambda f: fl.path_prefix(f, f.select(F.concat(F.lit("/srv/nd/"), F.col("library_id").cast("string"), F.lit("/"), "normalized_path").alias("remote"))),
    "SELECT concat('/srv/nd/', CAST(library_id AS VARCHAR), '/', normalized_path) AS remote, concat('/srv/nd/', CAST(library_id AS VARCHAR), '/') AS prefix FROM files",
    ("files",),
)
add(
    "files_in_folders",
    lambda f: fl.in_folders(f, f.where("album = 'STANDARD'").select("library_id", fl.parent(F.col("normalized_path")).alias("folder")).union(f.where("library_id = 1").select("library_id", F.col("album").alias("folder")))).select("file_id"),
    """
    , folders AS (
      SELECT DISTINCT library_id, regexp_replace(normalized_path, '/?[^/]*$', '') AS folder FROM files WHERE album = 'STANDARD'
      UNION SELECT library_id, album FROM files WHERE library_id = 1)
    SELECT file_id FROM files f WHERE EXISTS (SELECT 1 FROM folders d WHERE d.library_id = f.library_id AND starts_with(f.normalized_path, concat(d.folder, '/')))
    """,
    ("files",),
)
add(
    "library_of_path",
    lambda f, b: fl.library_of(f.select(F.concat(F.when(F.col("file_id") % 2 == 0, "music/asia/").when(F.col("file_id") % 3 == 0, "music/").otherwise("else/"), "normalized_path").alias("path")), b),
    """
    , p AS (SELECT concat(CASE WHEN file_id % 2 = 0 THEN 'music/asia/' WHEN file_id % 3 = 0 THEN 'music/' ELSE 'else/' END, normalized_path) AS path FROM files)
    SELECT path, (SELECT library_id FROM libraries WHERE starts_with(path, concat(root_path, '/')) ORDER BY length(root_path) DESC, library_id LIMIT 1) AS library_id FROM p
    """,
    ("files", "libraries"),
)
add(
    "libraries_listed",
    lambda b, s: fl.libraries_with_scan(b, s, True),
    """
    , last AS (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY started_at DESC, scan_id DESC) AS nth FROM library_scans)
    SELECT b.library_id, name, coalesce(status, 'idle') AS status, coalesce(files_processed, 0) AS files_processed
    FROM libraries b LEFT JOIN last l ON l.library_id = b.library_id AND nth = 1 WHERE is_enabled
    """,
    ("libraries", "library_scans"),
)
add("libraries_watchable", fl.watchable, "SELECT * FROM libraries WHERE is_enabled AND coalesce(watch_mode, 'off') <> 'off'", ("libraries",))
add(
    "library_by_name",
    lambda b: b.where("name = 'asia'").orderBy("library_id").limit(1),
    "SELECT * FROM libraries WHERE name = 'asia' ORDER BY library_id LIMIT 1",
    ("libraries",),
)
add(
    "tracks_by_ids",
    lambda f: fl.tracks_by_ids(f.select("file_id", "normalized_path", "artist", F.when(F.col("library_id") != 2, F.col("album")).alias("album"), F.when(F.col("library_id") != 1, F.col("title")).alias("title")), f.select("file_id", (-F.col("file_id")).alias("nth"))).orderBy("nth").limit(15),
    """
    SELECT file_id, CASE WHEN library_id <> 1 THEN title ELSE CAST(file_id AS VARCHAR) END AS title, artist, CASE WHEN library_id <> 2 THEN album ELSE 'Unknown Album' END AS album, -file_id AS nth
    FROM files ORDER BY nth LIMIT 15
    """,
    ("files",),
)
add(
    "files_recently_processed",
    lambda f, s: fl.recently_processed(f.withColumn("scanned_at", F.col("file_size") % 977), states.in_state(s, "tagged"), 20, 3).select("file_id", "scanned_at"),
    """
    SELECT file_id, file_size % 977 AS scanned_at FROM files WHERE library_id = 3 AND file_id IN (SELECT file_id FROM states WHERE axis = 'tagged' AND positive)
    ORDER BY scanned_at DESC, file_id LIMIT 20
    """,
    ("files", "states"),
)
add(
    "files_by_fingerprint",
    lambda f: f.withColumn("fingerprint", F.concat("album", F.lit("/"), "title")).join(f.where("library_id = 0").groupBy().agg(F.min(F.concat("album", F.lit("/"), "title")).alias("fingerprint")), "fingerprint", "left_semi").select("file_id", "fingerprint"),
    """
    , p AS (SELECT file_id, library_id, concat(album, '/', title) AS fingerprint FROM files)
    SELECT file_id, fingerprint FROM p WHERE fingerprint = (SELECT min(fingerprint) FROM p WHERE library_id = 0)
    """,
    ("files",),
)
add(
    "tag_songs",
    lambda t: fl.songs_of_tag(t, "genre", "ring").orderBy("file_id").offset(2).limit(25),
    "SELECT DISTINCT file_id FROM tags_long WHERE rel = 'genre' AND value_str = 'ring' ORDER BY file_id LIMIT 25 OFFSET 2",
    ("tags_long",),
)
add("tag_songs_total", lambda t: fl.songs_of_tag(t, "genre", "ring").agg(F.count("*").alias("total")), "SELECT count(DISTINCT file_id) AS total FROM tags_long WHERE rel = 'genre' AND value_str = 'ring'", ("tags_long",))
add(
    "tag_songs_metadata",
    lambda t: fl.songs_with_metadata(t, "genre", "ring"),
    """
    SELECT file_id, min(CASE WHEN rel = 'artist' THEN value_str END) AS artist, min(CASE WHEN rel = 'album' THEN value_str END) AS album
    FROM tags_long WHERE file_id IN (SELECT file_id FROM tags_long WHERE rel = 'genre' AND value_str = 'ring') GROUP BY file_id
    """,
    ("tags_long",),
)
add(
    "tag_values_of_files",
    lambda f, t: t.where("rel = 'genre' AND value_str IS NOT NULL").join(f.where("library_id = 4"), "file_id", "left_semi").select("value_str").distinct(),
    "SELECT DISTINCT value_str FROM tags_long JOIN files USING (file_id) WHERE rel = 'genre' AND library_id = 4 AND value_str IS NOT NULL",
    FT,
)
add(
    "files_of_specs",
    lambda t: fl.files_of_specs(t, specs(t, ("genre", "ring"), ("nom:mood-loose", "*"), ("year", "1994"), ("album", "nothing"))),
    """
    SELECT DISTINCT rel, CASE WHEN rel = 'nom:mood-loose' THEN '*' ELSE coalesce(value_str, '1994') END AS value, file_id FROM tags_long
    WHERE (rel = 'genre' AND value_str = 'ring') OR rel = 'nom:mood-loose' OR (rel = 'year' AND value_num = 1994)
    """,
    ("tags_long",),
)
add(
    "tag_cooccurrence_matrix",
    lambda t: fl.cooccurrence_matrix(t, specs(t, ("genre", "ring"), ("genre", "small"), ("nom:mood-strict", "*")), specs(t, ("nom:mood-loose", "1-URGENT"), ("nom:mood-loose", "5-LOW"), ("album", "nothing"))),
    """
    , xs(x, rel, v) AS (VALUES ('genre:ring', 'genre', 'ring'), ('genre:small', 'genre', 'small'), ('nom:mood-strict:*', 'nom:mood-strict', '*')),
    ys(y, rel, v) AS (VALUES ('nom:mood-loose:1-URGENT', 'nom:mood-loose', '1-URGENT'), ('nom:mood-loose:5-LOW', 'nom:mood-loose', '5-LOW'), ('album:nothing', 'album', 'nothing'))
    SELECT x, y, (SELECT count(*) FROM files f WHERE EXISTS (SELECT 1 FROM tags_long t WHERE t.file_id = f.file_id AND t.rel = xs.rel AND (xs.v = '*' OR t.value_str = xs.v))
      AND EXISTS (SELECT 1 FROM tags_long t WHERE t.file_id = f.file_id AND t.rel = ys.rel AND t.value_str = ys.v)) AS n_files
    FROM xs CROSS JOIN ys
    """,
    ("tags_long",),
)
add(
    "artists_of_album",
    lambda t: fl.linked_entities(t, "album", "STANDARD", "artist").orderBy("name").limit(10).select("name"),
    "SELECT DISTINCT a.value_str AS name FROM tags_long a JOIN tags_long b USING (file_id) WHERE a.rel = 'artist' AND b.rel = 'album' AND b.value_str = 'STANDARD' ORDER BY 1 LIMIT 10",
    ("tags_long",),
)
add(
    "albums_for_artist",
    lambda t: fl.linked_entities(t, "artist", "Brand#13", "album"),
    "SELECT a.value_str AS name, count(DISTINCT file_id) AS song_count FROM tags_long a JOIN tags_long b USING (file_id) WHERE a.rel = 'album' AND b.rel = 'artist' AND b.value_str = 'Brand#13' GROUP BY 1",
    ("tags_long",),
)
add(
    "entity_counts",
    fl.entity_counts,
    "SELECT " + ", ".join(f"count(DISTINCT CASE WHEN rel = '{r}' THEN coalesce(value_str, CAST(value_num AS VARCHAR)) END) AS {n}" for n, r in fl.COLLECTIONS.items()) + " FROM tags_long",
    ("tags_long",),
)
add(
    "links_files_to_nd",
    lambda f, k: fl.resolve_links(f, k, "file_id"),
    "SELECT f.file_id, max(nd_id) AS nd_id FROM files f JOIN nd_links k USING (file_id) GROUP BY 1",
    ("files", "nd_links"),
)
add(
    "links_nd_to_files",
    lambda p, k: fl.resolve_links(p.select(F.concat(F.lit("nd"), F.col("nd_id").cast("string")).alias("nd_id")), k, "nd_id"),
    "SELECT DISTINCT k.nd_id, k.file_id FROM plays p JOIN nd_links k ON k.nd_id = concat('nd', CAST(p.nd_id AS VARCHAR))",
    ("plays", "nd_links"),
)
add(
    "files_upserted",
    lambda f: fl.upserted(
        f.where("library_id <> 4").select("file_id", "title", "file_size", "artist"),
        f.where("library_id >= 3").select("file_id", F.when(F.col("file_size") % 2 == 0, F.upper("title")).alias("title"), (F.col("file_size") + 1).alias("file_size")),
        ["file_id"],
        ["title", "file_size"],
    ),
    """
    SELECT file_id, CASE WHEN library_id >= 3 AND file_size % 2 = 0 THEN upper(title) WHEN library_id = 4 THEN NULL ELSE title END AS title,
      CASE WHEN library_id >= 3 THEN file_size + 1 ELSE file_size END AS file_size, CASE WHEN library_id <> 4 THEN artist END AS artist FROM files
    """,
    ("files",),
)
add("vectors_without_files", lambda v, c: fl.without(v, c, "file_id").select("file_id", "genre_id"), "SELECT file_id, genre_id FROM vectors WHERE file_id NOT IN (SELECT file_id FROM claims)", ("vectors", "claims"))
add(
    "files_missing",
    lambda f: fl.missing_files(
        f,
        f.where("title NOT LIKE '%ring%'"),
        f.where("library_id IN (0, 1)").select(fl.parent(F.col("normalized_path")).alias("folder")),
        f.where("artist <> 'Brand#13'").select(fl.parent(F.col("normalized_path")).alias("folder")),
    ),
    """
    , p AS (SELECT *, regexp_replace(normalized_path, '/?[^/]*$', '') AS folder FROM files)
    SELECT normalized_path FROM p WHERE title LIKE '%ring%'
      AND (folder IN (SELECT folder FROM p WHERE library_id IN (0, 1)) OR folder NOT IN (SELECT folder FROM p WHERE artist <> 'Brand#13'))
    """,
    ("files",),
)
