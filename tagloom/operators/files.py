"""Selections of files, files with their tags nested, folders, libraries and the entities that tags name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parent(path: Column) -> Column:
    """The folder of a path; empty at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """All folders above a path, the root (empty) among them: what turns a prefix join into an equi-join."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def by_path(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Each of `paths` (path) with the file of smallest id that has it, as its path or its normalised path; null where none has."""
    keyed = files.select("file_id", F.explode(F.array_distinct(F.array_compact(F.array("path", "normalized_path")))).alias("path"))
    return paths.select("path").distinct().join(keyed.groupBy("path").agg(F.min("file_id").alias("file_id")).hint("merge"), "path", "left")


def path_prefix(files: DataFrame, remote: DataFrame) -> DataFrame:
    """Of each remote path the shortest beginning that, taken off, leaves the path of a file; remote paths without such a file are left out.

    The ends of a remote path at its slashes are looked up by equality. Paths
    are many times larger in memory than in their files, so here and below
    joins of what grows with the library are merged: a broadcast would pass it
    through the driver.
    """
    parts = F.split("remote", "/")
    ends = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "/"))
    each = remote.select("remote", F.explode(ends).alias("normalized_path"))
    found = each.join(files.select("normalized_path").distinct().hint("merge"), "normalized_path")
    prefix = F.expr("substring(remote, 1, length(remote) - length(normalized_path))")
    return found.groupBy("remote").agg(F.min_by(prefix, F.length("remote") - F.length("normalized_path")).alias("prefix"))


def page(files: DataFrame, offset: int, limit: int, artist: str | None = None, album: str | None = None, library: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A page in the order of artist, album, title and id, and the total as one row."""
    for c, v in (("artist", artist), ("album", album), ("library_id", library)):
        if v is not None:
            files = files.where(F.col(c) == v)
    return files.orderBy("artist", "album", "title", "file_id").offset(offset).limit(limit), files.agg(F.count("*").alias("total"))


def with_tags(files: DataFrame, tags: DataFrame) -> DataFrame:
    """`files` with `tags`, an array of key, value (as text), type (float or string) and own (of the namespace), in the order of key and value; empty without any."""
    number = F.col("value_str").isNull()
    text = F.when(number, F.col("value_num").cast("string")).otherwise(F.col("value_str"))
    one = F.struct(F.col("rel").alias("key"), text.alias("value"), F.when(number, "float").otherwise("string").alias("type"), F.col("rel").startswith("nom:").alias("own"))
    nested = tags.where("value_str is not null or value_num is not null").groupBy("file_id").agg(F.array_sort(F.collect_list(one)).alias("tags"))
    none = F.array().cast(nested.schema["tags"].dataType)
    return files.join(nested.hint("merge"), "file_id", "left").withColumn("tags", F.coalesce("tags", none))


def search(files: DataFrame, tags: DataFrame, tagged: DataFrame, text: str | None = None, artist: str | None = None, album: str | None = None, tag_key: str | None = None, tag_value: str | None = None, tagged_only: bool = False) -> DataFrame:
    """Files that fit all that is given: text in artist, album or title (any case), equal artist and album, a tag of this key (and value), and being tagged."""
    found = files
    if text:
        like = f"%{text.lower()}%"
        found = found.where(F.lower("artist").like(like) | F.lower("album").like(like) | F.lower("title").like(like))
    if artist:
        found = found.where(F.col("artist") == artist)
    if album:
        found = found.where(F.col("album") == album)
    if tag_key:
        own = tags.where(F.col("rel") == tag_key)
        if tag_value:
            own = own.where(F.coalesce("value_str", F.col("value_num").cast("string")) == tag_value)
        found = found.join(own.select("file_id"), "file_id", "left_semi")
    return found.join(tagged.select("file_id"), "file_id", "left_semi") if tagged_only else found


def in_folders(files: DataFrame, folders: DataFrame) -> DataFrame:
    """The files below any of the folders (library_id, folder), each once; the root's folder is empty and has only the files that lie in none.

    Each file's ancestors are joined by equality, which no number of folders makes quadratic.
    """
    deep = F.array_size(F.split("normalized_path", "/")) > 1
    keyed = files.select("library_id", "file_id", deep.alias("deep"), F.explode(ancestors(F.col("normalized_path"))).alias("folder")).where("folder <> '' OR NOT deep")
    hit = keyed.join(folders.distinct().hint("merge"), ["library_id", "folder"]).select("file_id").distinct()
    return files.join(hit.hint("merge"), "file_id", "left_semi")


def library_of(paths: DataFrame, libraries: DataFrame) -> DataFrame:
    """Each path (path) with the library of the longest root that is a folder above it; null where there is none."""
    up = paths.select("path", F.explode(ancestors(F.col("path"))).alias("root_path"))
    found = up.join(libraries.select("library_id", "root_path"), "root_path")
    best = found.groupBy("path").agg(F.max_by("library_id", F.struct(F.length("root_path"), -F.col("library_id"))).alias("library_id"))
    return paths.join(best.hint("merge"), "path", "left")


def libraries_with_scan(libraries: DataFrame, scans: DataFrame, enabled_only: bool = False) -> DataFrame:
    """Libraries with the status and progress of their latest scan; idle and 0 where there was none."""
    last = scans.groupBy("library_id").agg(F.max_by(F.struct("status", "files_processed"), F.struct("started_at", "scan_id")).alias("s"))
    own = libraries.where("is_enabled") if enabled_only else libraries
    return own.join(last, "library_id", "left").select("library_id", "name", F.coalesce("s.status", F.lit("idle")).alias("status"), F.coalesce("s.files_processed", F.lit(0)).alias("files_processed"))


def watchable(libraries: DataFrame) -> DataFrame:
    return libraries.where("is_enabled AND watch_mode IS NOT NULL AND watch_mode <> 'off'")


def tracks_by_ids(files: DataFrame, ids: DataFrame, seed: int | None = None) -> DataFrame:
    """The listed files (file_id, nth) as tracks: title (else the file's name without its ending), artist and album with defaults; `nth` orders them, or a seeded shuffle."""
    stem = F.regexp_replace(F.element_at(F.split("normalized_path", "/"), -1), r"\.[^.]*$", "")
    order = F.col("nth") if seed is None else F.rand(seed)
    return files.join(ids, "file_id").select("file_id", F.coalesce("title", stem).alias("title"), F.coalesce("artist", F.lit("Unknown Artist")).alias("artist"), F.coalesce("album", F.lit("Unknown Album")).alias("album"), order.alias("nth"))


def songs_of_tag(tags: DataFrame, rel: str, value: str) -> DataFrame:
    return tags.where((F.col("rel") == rel) & (F.col("value_str") == value)).select("file_id").distinct()


def songs_with_metadata(tags: DataFrame, rel: str, value: str) -> DataFrame:
    """The songs of a tag, each with its first artist and album."""
    first = lambda r: F.min(F.when(F.col("rel") == r, F.col("value_str"))).alias(r)
    own = tags.where("rel IN ('artist', 'album')").join(songs_of_tag(tags, rel, value), "file_id", "left_semi")
    return songs_of_tag(tags, rel, value).join(own.groupBy("file_id").agg(first("artist"), first("album")), "file_id", "left")


def files_of_specs(tags: DataFrame, specs: DataFrame) -> DataFrame:
    """rel, value and file_id of the files that have each specified tag (rel, value as text). A value of * takes any; texts of numbers take numbers as well."""
    text = F.coalesce("value_str", F.col("value_num").cast("string"))
    own = tags.select("file_id", "rel", text.alias("text"), "value_num")
    named = specs.where("value <> '*'").withColumn("number", F.expr("try_cast(value AS double)"))
    # two equi-joins, by text and by number, so that a rel with many values is not a key of its own
    by_text = own.withColumnRenamed("text", "value").join(named.select("rel", "value"), ["rel", "value"])
    by_number = own.join(named.where("number IS NOT NULL").select("rel", "value", F.col("number").alias("value_num")), ["rel", "value_num"])
    any_value = own.join(specs.where("value = '*'"), "rel")
    each = lambda df: df.select("rel", "value", "file_id")
    return each(by_text).union(each(by_number)).union(each(any_value)).distinct()


def cooccurrence_matrix(tags: DataFrame, xs: DataFrame, ys: DataFrame) -> DataFrame:
    """For each pair of specified tags x and y in how many files both are, zero included. Specifications are few; files are joined by equality."""
    one = files_of_specs(tags, xs).select(F.concat("rel", F.lit(":"), "value").alias("x"), "file_id")
    two = files_of_specs(tags, ys).select(F.concat("rel", F.lit(":"), "value").alias("y"), "file_id")
    counts = one.join(two, "file_id").groupBy("x", "y").agg(F.count("*").alias("n"))
    name = F.concat("rel", F.lit(":"), "value")
    # the frame of the matrix: one row a pair of specifications
    frame = xs.select(name.alias("x")).crossJoin(ys.select(name.alias("y")))
    return frame.join(counts, ["x", "y"], "left").select("x", "y", F.coalesce("n", F.lit(0)).alias("n_files"))


def linked_entities(tags: DataFrame, rel: str, value: str, other: str) -> DataFrame:
    """The values of another rel that songs of this tag have, and of how many of them: artists of an album, albums of an artist."""
    own = tags.where((F.col("rel") == other) & F.col("value_str").isNotNull()).join(songs_of_tag(tags, rel, value), "file_id", "left_semi")
    return own.groupBy(F.col("value_str").alias("name")).agg(F.countDistinct("file_id").alias("song_count"))


#: The collections that can be browsed, and their rels.
COLLECTIONS = {"artists": "artist", "albums": "album", "genres": "genre", "years": "year", "labels": "label"}


def entity_counts(tags: DataFrame) -> DataFrame:
    """One row: how many different values each collection has."""
    rel, value = F.col("rel"), F.coalesce("value_str", F.col("value_num").cast("string"))
    return tags.where(rel.isin(list(COLLECTIONS.values()))).agg(*(F.countDistinct(F.when(rel == r, value)).alias(name) for name, r in COLLECTIONS.items()))


def resolve_links(ids: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Each id of `key` (nd_id or file_id) with what it is linked to, the largest of several; ids without a link are left out."""
    other = "file_id" if key == "nd_id" else "nd_id"
    return ids.select(key).distinct().join(links.groupBy(key).agg(F.max(other).alias(other)).hint("merge"), key)


def recently_processed(files: DataFrame, tagged: DataFrame, limit: int, library: int | None = None) -> DataFrame:
    """The tagged files that were scanned last (scanned_at); ties by id."""
    own = files if library is None else files.where(F.col("library_id") == library)
    return own.join(tagged.select("file_id"), "file_id", "left_semi").orderBy(F.col("scanned_at").desc(), "file_id").limit(limit)


def upserted(table: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The table after rows of `new`: rows with a known key keep what `new` leaves null, others are added. Of several new rows of a key the largest counts."""
    w = Window.partitionBy(*key).orderBy(*(F.col(c).desc_nulls_last() for c in columns))
    last = new.withColumn("nth", F.row_number().over(w)).where("nth = 1")
    fresh = last.select(*key, *(F.col(c).alias(f"new_{c}") for c in columns))
    rest = [c for c in table.columns if c not in (*key, *columns)]
    return table.join(fresh, key, "full").select(*key, *(F.coalesce(f"new_{c}", c).alias(c) for c in columns), *rest)


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The table without the rows of these keys; a cascade is this for each dependent table."""
    return table.join(gone.select(key), key, "left_anti")


def missing_files(known: DataFrame, seen: DataFrame, scanned: DataFrame, on_disk: DataFrame) -> DataFrame:
    """The known files (normalized_path) that a scan did not see, and whose folder it scanned, or that is no longer there."""
    gone = known.join(seen.select("normalized_path").hint("merge"), "normalized_path", "left_anti").withColumn("folder", parent(F.col("normalized_path")))
    was = gone.join(scanned.select("folder"), "folder", "left_semi")
    lost = gone.join(on_disk.select("folder"), "folder", "left_anti")
    return was.union(lost).select("normalized_path").distinct()
