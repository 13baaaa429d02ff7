"""Addresses of playlists at streaming services: which service, and which list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands before a list's id.
SPOTIFY_WEB, SPOTIFY_URI = "spotify.com/playlist/", "spotify:playlist:"
DEEZER, DEEZER_LIST, DEEZER_SHORT = "deezer.com/", "playlist/", "link.deezer.com/"


def _behind(c: Column, mark: str) -> Column:
    """What follows the first `mark`; null without it."""
    return F.when(F.instr(c, mark) > 0, F.substring(c, F.instr(c, mark) + F.lit(len(mark)), F.length(c)))


def _leading(c: Column, kind: str) -> Column:
    """The characters of a kind at the beginning; null if there are none."""
    found = F.regexp_extract(c, f"^[{kind}]+", 0)
    return F.when(found != "", found)


def playlist_of(url: Column) -> Column:
    """platform, playlist_id and is_short_link of an address; null for what is none. A short link has an empty id until it is followed."""
    said = F.trim(url)
    named = lambda mark: _leading(_behind(said, mark), "A-Za-z0-9")
    spotify = F.coalesce(named(SPOTIFY_WEB), named(SPOTIFY_URI))
    path = _behind(said, DEEZER)
    # a language may stand before the list
    path = F.when(F.substring(path, 3, 1) == "/", F.when(_leading(F.substring(path, 1, 2), "a-z") == F.substring(path, 1, 2), F.substring(path, 4, 1 << 20))).otherwise(path)
    deezer = F.when(path.startswith(DEEZER_LIST), _leading(F.substring(path, len(DEEZER_LIST) + 1, 1 << 20), "0-9"))
    one = lambda platform, id_, short: F.struct(F.lit(platform).alias("platform"), id_.alias("playlist_id"), F.lit(short).alias("is_short_link"))
    return (
        F.when(spotify.isNotNull(), one("spotify", spotify, False))
        .when(deezer.isNotNull(), one("deezer", deezer, False))
        .when(F.instr(said, DEEZER_SHORT) > 0, one("deezer", F.lit(""), True))
    )
