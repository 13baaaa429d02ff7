"""Pairs of lines are verified from their texts, which are split once."""

import random

from pyspark.sql import functions as F

from tagloom.llm import line_dedup
from tagloom.llm.common import Kept


def test_texts_are_split_once(spark, monkeypatch):
    split, lines = [], line_dedup._lines

    def counted(docs):
        split.append(docs)
        return lines(docs)

    monkeypatch.setattr(line_dedup, "_lines", counted)
    blank = " \t\x0b\x0c\r"
    texts = ["one line of some length\n" + blank + "\n\x1c\n　", blank + "\none line of some length", "\x1c\n　\n ", None]
    out = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    # only ASCII white space is blank
    assert {r.doc_id: r.text for r in out} == {0: texts[0], 1: blank, 2: " ", 3: None}
    assert len(split) == 1


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    lines = ["x", "xy", "x" * 7, "x" * 8, "x" * 9, "x" * 400, "ab" * 300, "ba" * 300]
    for letters in ("abc ", "aé ü", "日本語あ", "a😀b🎉 "):
        for n in (9, 30, 200):
            line = [rng.choice(letters) for _ in range(n)]
            for changes in (0, 1, 2, 4):
                own = list(line)
                for _ in range(changes):
                    own[rng.randrange(n)] = rng.choice(letters)
                lines.append("".join(own))
    lines = sorted(set(lines))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    kept = Kept(spark)
    rows = kept.write(line_dedup._lines(docs))
    one, two = (rows.select(F.col("doc_id").alias(f"{x}id"), F.col("k").alias(f"{x}k"), F.col("c").alias(f"{x}c")) for x in "ab")
    links = line_dedup._Verifier(rows, rows, kept).links(one.join(two, F.col("aid") < F.col("bid")).select("ak", "ac", "bk", "bc"))
    ids = {(r.k, r.c): r.doc_id for r in rows.collect()}
    got = {tuple(sorted((ids[r.a.k, r.a.c], ids[r.b.k, r.b.c]))) for r in links.where("alike").collect()}
    sets = [{x[j : j + 8] for j in range(max(1, len(x) - 7))} for x in lines]
    want = {(i, j) for j in range(len(lines)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert got == want and len(want) > 10
