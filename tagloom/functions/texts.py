"""Texts of tags made into values, and texts made comparable."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that begin a featured artist.
FEATURING = ("feat", "feat.", "featuring", "ft", "ft.", "with", "&", "x")
#: What a bracket at the end says about a version.
VERSIONS = (
    "remaster", "remastered", "live", "version", "album version", "original version", "original album version",
    "mono", "mono version", "stereo", "stereo version", "radio edit", "single version", "bonus track", "explicit", "clean", "clean version",
)
#: Beginnings after which a bracket may go on.
VERSION_OF = ("live at ", "live from ", "live in ")


def _non_empty(c: Column) -> Column:
    return F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")


def multi_values(value: Column) -> Column:
    """A JSON array's values or the one value, each split at semicolons, trimmed, without empty ones; none for null."""
    listed = F.from_json(F.when(value.startswith("[") & value.endswith("]"), value), "array<string>")
    raw = F.coalesce(F.filter(listed, lambda x: x.isNotNull() & (x != "")), F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value)))
    return _non_empty(F.flatten(F.transform(raw, lambda v: F.split(v, ";"))))


def typed_values(value: Column) -> Column:
    """Values of a text as structs of value_str and value_num: of a JSON array, of a tuple in brackets, of parts between semicolons, or the one value.

    Numbers are recognised in a lone value and in arrays, not between semicolons or in tuples. Null and empty texts have none.
    """
    word = lambda v: F.struct(v.alias("value_str"), F.lit(None).cast("double").alias("value_num"))
    number = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

    def typed(v: Column) -> Column:
        is_number = v.rlike(number)
        return F.struct(F.when(~is_number, v).alias("value_str"), F.when(is_number, F.trim(v).cast("double")).alias("value_num"))

    listed = F.from_json(F.when(value.startswith("[") & value.endswith("]"), value), "array<string>")
    inside = F.substring(value, 2, 1 << 20)
    quoted = F.regexp_extract_all(F.when(value.startswith("('") & value.endswith(")"), inside), F.lit(r"'([^']*)'"), 1)
    empty = F.array().cast("array<struct<value_str:string,value_num:double>>")
    return (
        F.when(value.isNull() | (value == ""), empty)
        .when(listed.isNotNull(), F.transform(listed, typed))
        .when(quoted.isNotNull() & (F.size(quoted) > 0), F.transform(quoted, word))
        .when(value.contains(";"), F.transform(_non_empty(F.split(value, ";")), word))
        .otherwise(F.array(typed(value)))
    )


def artists(artist: Column, listed: Column) -> Column:
    """artist and artists: each is filled from the other; several artists are parted by semicolon, comma or slash and named once, in order."""
    one = F.get(multi_values(artist), F.lit(0))
    many = F.array_distinct(_non_empty(F.flatten(F.transform(multi_values(listed), lambda v: F.split(v, "[;,/]")))))
    first = F.coalesce(one, F.get(many, F.lit(0)))
    return F.struct(first.alias("artist"), F.when(F.size(many) > 0, many).when(first.isNotNull(), F.array(first)).alias("artists"))


def n_of_total(n: Column, total: Column) -> Column:
    """Track and disc numbers: n/total, or n where the total is unknown."""
    return F.when(total > 0, F.concat_ws("/", n.cast("string"), total.cast("string"))).otherwise(n.cast("string"))


def played_ms(text: Column) -> Column:
    """ISO 8601 as milliseconds since 1970; without an offset it is UTC, and what is no time is 0."""
    zoned = F.when(text.rlike(r"([zZ]|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.coalesce(F.unix_millis(F.try_to_timestamp(zoned)), F.lit(0))


def plain(text: str) -> str:
    """A title or name made comparable: NFKC, lower case, without featured artists and then versions at the end, apostrophes and punctuation, with single spaces.

    Markers of featured artists count as whole words, so that "max y" stays;
    all from the first one on goes, unless a bracket closes before the end.
    Versions go as long as the text ends with a bracket that names one.
    """
    words = unicodedata.normalize("NFKC", text).lower().split()
    for i, w in enumerate(words[:-1]):
        if w.lstrip("([") in FEATURING and not set(" ".join(words[i:])[:-1]) & set(")]"):
            words = " ".join(words[:i]).rstrip("([").split()
            break
    t = " ".join(words)
    while t and t[-1] in ")]" and (at := max(t.rfind("("), t.rfind("["))) >= 0:
        said = t[at + 1 : -1].strip()
        name, _, year = said.rpartition(" ")
        said = name if len(year) == 4 and year.isdecimal() and name in ("remaster", "remastered") else said
        if said not in VERSIONS and not said.startswith(VERSION_OF):
            break
        t = t[:at].rstrip()
    return " ".join("".join(" " if not (c.isalnum() or c in "_'’" or c.isspace()) else c for c in t).replace("'", "").replace("’", "").split())


@F.pandas_udf(StringType())
def comparable(s: pd.Series) -> pd.Series:
    """`plain` of a column; null is empty. Spark has no function for NFKC, so that the whole of this small step is Python, a batch at a time."""
    return s.fillna("").map(plain)


def comparable_artist(c: Column) -> Column:
    return F.regexp_replace(comparable(c), "^the ", "")


def comparable_album(c: Column) -> Column:
    """Without a disc's number at the end besides."""
    return F.trim(F.regexp_replace(comparable(c), r"\s*(disc|cd)\s*\d+\s*$", ""))
