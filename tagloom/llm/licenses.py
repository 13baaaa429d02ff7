"""Licence scans by a positional rare-token index, in DataFrame functions only.

Templates are short texts whose postings say where each word stands. Of
each template's key phrase the word with the highest inverse document frequency
(over the whole table) is looked up, however common it is: each of its places
gives an alignment, and a template is found where its mandatory key phrase
stands in full and enough of its other words stand at the places that the
alignment gives them; it may begin before the text's first word. A few base phrases are
looked for at every place besides.

Cases: a null text counts as empty; an empty one has no words, no labels (the
empty string) and score 0; repeated rows come out repeated; an empty table
gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, words

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, template, mandatory key phrase within it: fixed wordings of public licences.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]
#: This share of a template's words must stand in place.
COVERAGE = 0.5


def _templates() -> list[tuple[str, list[str], int, int]]:
    out = []
    for label, text, key in TEMPLATES:
        w, k = text.split(), key.split()
        at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
        out.append((label, w, at, len(k)))
    return out


def _strings(xs: list[str]) -> Column:
    return F.array(*map(F.lit, xs))


def frequencies(texts: DataFrame) -> dict[str, int]:
    """In how many texts (column `w`) each word of the templates' key phrases stands."""
    vocabulary = sorted({w for _, ws, at, n in _templates() for w in ws[at : at + n]})
    counts = texts.select(F.explode(F.array_intersect("w", _strings(vocabulary))).alias("word")).groupBy("word").count().collect()
    return {r["word"]: r["count"] for r in counts}


def _found(template: tuple[str, list[str], int, int], df: dict[str, int]) -> Column:
    """The template's label and coverage at its best alignment (columns `w`, the words, and `at`, places of words looked up), or null."""
    label, ws, key_at, key_n = template
    rarest, key = _rarest(template, df), " ".join(ws[key_at : key_at + key_n])
    posts = [k for k in range(key_at, key_at + key_n) if ws[k] == rarest]

    def coverage(o: Column) -> Column:
        # words before the text's first are not there
        same = F.array(*(F.coalesce(F.when(o + k >= 0, F.get("w", o + k) == w), F.lit(False)) for k, w in enumerate(ws)))
        return F.size(F.filter(same, lambda x: x)) / F.lit(float(len(ws)))

    places = F.filter("at", lambda i: F.get("w", i) == rarest)
    offsets = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(*(i - k for k in posts)))))
    verified = F.filter(offsets, lambda o: F.when(o + key_at >= 0, F.array_join(F.slice("w", F.greatest(o + key_at, F.lit(0)) + 1, key_n), " ") == key))
    best = F.when(F.size("at") > 0, F.array_max(F.transform(verified, coverage)))
    return F.when(best >= COVERAGE, F.struct(F.lit(label).alias("label"), best.alias("score")))


def _rarest(template: tuple[str, list[str], int, int], df: dict[str, int]) -> str:
    """The word of the template's key phrase that the fewest texts have."""
    _, ws, at, n = template
    return min(ws[at : at + n], key=lambda w: (df.get(w, 0), w))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the base phrases' places and labels, all labels and a score for each text."""
    texts = docs.select("doc_id", words(text_of()).alias("w"))
    df = frequencies(texts)
    templates = _templates()
    wanted = sorted({_rarest(t, df) for t in templates})
    def base(w: Column, i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in BASE.items():
            first, *rest = phrase.split()
            hit = w == first
            for k, x in enumerate(rest, 1):
                hit = hit & (F.get("w", i + k) == x)
            out = F.when(hit, F.lit(label)).otherwise(out)
        return out

    firsts = [p.split() for p in BASE]
    any_base = F.lit(False)
    for p in firsts:
        both = F.lit(True)
        for x in p:
            both = both & F.array_contains("w", x)
        any_base = any_base | both
    none = F.array().cast("array<struct<at:int,label:string>>")
    places = F.when(any_base, F.filter(F.transform("w", lambda w, i: F.struct(i.alias("at"), base(w, i).alias("label"))), lambda x: x["label"].isNotNull())).otherwise(none)
    looked = F.when(F.arrays_overlap("w", _strings(wanted)), F.array_compact(F.transform("w", lambda w, i: F.when(w.isin(wanted), i)))).otherwise(F.array().cast("array<int>"))
    held = texts.select("doc_id", "w", places.alias("base"), looked.alias("at"))

    matches = F.array_compact(F.array(*(_found(t, df) for t in templates)))
    out = held.select("doc_id", F.size("w").cast("long").alias("n_words"), "base", matches.alias("m"))
    base_labels = F.array_sort(F.array_distinct(F.col("base.label")))
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.at")).cast("long").alias("first_word"),
        F.array_max(F.col("base.at")).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.col("base.label"), F.col("m.label")))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("m.score")), F.lit(0.0))).alias("score"),
    )
