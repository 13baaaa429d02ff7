"""Raw tags of audio containers brought to one set of keys, and what files are seeded with from them.

Raw tags have file_id, container (mp4, id3 or vorbis), pos (their order), key and
values (array of texts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import artists, multi_values

#: The keys that are kept, besides those of the namespace.
CANONICAL = ("title", "artist", "artists", "album", "album_artist", "tracknumber", "discnumber", "date", "year", "genre", "composer", "lyricist", "label", "publisher", "bpm")
#: MP4 atoms.
MP4 = {"\xa9nam": "title", "\xa9ART": "artist", "\xa9alb": "album", "aART": "album_artist", "\xa9gen": "genre", "\xa9day": "date", "trkn": "tracknumber", "disk": "discnumber", "\xa9wrt": "composer", "tmpo": "bpm"}
#: MP4 free-form atoms, behind FREE.
MP4_FREE = {"ARTISTS": "artists", "LABEL": "label", "originaldate": "date", "originalyear": "year"}
FREE = "----:com.apple.iTunes:"
#: ID3 frames.
ID3 = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TPE2": "album_artist", "TCON": "genre", "TDRC": "date", "TYER": "year", "TRCK": "tracknumber", "TPOS": "discnumber", "TCOM": "composer", "TEXT": "lyricist", "TPUB": "publisher", "TBPM": "bpm"}
#: ID3 user frames, behind TXXX:, in capitals.
ID3_USER = {"ARTISTS": "artists", "LABEL": "label"}
#: Vorbis comments whose key is not the canonical one in capitals.
VORBIS_OTHER = {"ALBUMARTIST": "album_artist", "TEMPO": "bpm"}
#: The rels that files are seeded with.
SEEDED = ("artist", "artists", "album", "label", "genre", "year")


def _look_up(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def canonical_key(container: Column, key: Column) -> Column:
    """The key under which a container's tag is kept; null if it isn't. Keys of the namespace are kept in every container."""
    free = F.replace(key, F.lit(FREE), F.lit(""))
    mp4 = F.when(key.startswith(FREE), F.when(free.startswith("nom:"), free).otherwise(_look_up(MP4_FREE, free))).otherwise(_look_up(MP4, key))
    user = F.substring(key, 6, 1 << 20)
    id3 = F.when(key.startswith("TXXX:"), F.when(user.startswith("nom:"), user).otherwise(_look_up(ID3_USER, F.upper(user)))).otherwise(_look_up(ID3, F.substring(key, 1, 4)))
    upper = F.upper(key)
    same = {c.upper(): c for c in CANONICAL if "_" not in c}
    spaced = F.concat(F.lit("nom:"), F.replace(F.lower(F.substring(key, 5, 1 << 20)), F.lit("_"), F.lit("-")))
    vorbis = F.when(upper.startswith("NOM_"), spaced).when(F.lower(key).startswith("nom:"), key).otherwise(_look_up(same | VORBIS_OTHER, upper))
    return F.when(container == "mp4", mp4).when(container == "id3", id3).when(container == "vorbis", vorbis)


def normalised(raw: DataFrame) -> DataFrame:
    """file_id, key and values of the tags that are kept; of several tags of one key the last counts."""
    kept = raw.withColumn("key", canonical_key(F.col("container"), F.col("key"))).where("key is not null")
    return kept.groupBy("file_id", "key").agg(F.max_by("values", "pos").alias("values"))


def entity_tags(tags: DataFrame) -> DataFrame:
    """The tags (file_id, rel, value) that a file is seeded with from its normalised tags: artists filled from the artist or the other way round, several labels and genres, and the year of the date."""
    text = F.to_json("values")
    of = lambda k: F.max(F.when(F.col("key") == k, text)).alias(k)
    wide = tags.groupBy("file_id").agg(*(of(k) for k in ("artist", "artists", "album", "label", "genre", "year", "date")))
    who = artists(F.col("artist"), F.col("artists"))
    first = lambda c: F.slice(multi_values(F.col(c)), 1, 1)
    year = F.regexp_extract(F.coalesce(F.get(multi_values(F.col("year")), F.lit(0)), F.get(multi_values(F.col("date")), F.lit(0)), F.lit("")), r"\d{4}", 0)
    held = wide.withColumn("who", who)
    none = F.array().cast("array<string>")
    values = {
        "artist": F.when(F.col("who.artist").isNotNull(), F.array("who.artist")).otherwise(none),
        "artists": F.coalesce("who.artists", none),
        "album": first("album"),
        "label": multi_values(F.col("label")),
        "genre": multi_values(F.col("genre")),
        "year": F.when(year != "", F.array(year)).otherwise(none),
    }
    named = lambda rel: lambda x: F.struct(F.lit(rel).alias("rel"), x.alias("value"))
    dealt = F.concat(*(F.transform(v, named(rel)) for rel, v in values.items()))
    return held.select("file_id", F.explode(F.array_distinct(dealt)).alias("t")).select("file_id", "t.rel", "t.value")


def cache_fields(tags: DataFrame) -> DataFrame:
    """Per file what its row repeats of its tags (file_id, rel, value): the first artist and album, sorted artists, labels and genres, and the year as a number."""
    values = lambda r: F.array_sort(F.collect_set(F.when(F.col("rel") == r, F.col("value"))))
    first = lambda r: F.min(F.when(F.col("rel") == r, F.col("value")))
    return tags.groupBy("file_id").agg(first("artist").alias("artist"), first("album").alias("album"), values("artists").alias("artists"), values("label").alias("labels"), values("genre").alias("genres"), first("year").try_cast("int").alias("year"))
