"""Lines of small buckets are settled at once, and are not dealt out."""

import random

from tagloom.llm import line_dedup


def test_lines_of_small_buckets_are_not_dealt(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    head = [word() for _ in range(25)]
    lines = []
    for _ in range(4):
        # of one template, so that unlike lines meet; each with a near copy
        tail = [word() for _ in range(25)]
        lines += [" ".join(head + tail), " ".join(head + tail[:-1] + [word()])]
    dealt, deal = [], line_dedup._dealt

    def counted(members, *more):
        dealt.append(members.count())
        return deal(members, *more)

    monkeypatch.setattr(line_dedup, "_dealt", counted)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert dealt == [0]
    assert [out[i] == "" for i in range(8)] == [False, True] * 4
