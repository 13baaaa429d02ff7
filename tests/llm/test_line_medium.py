"""Lines of medium buckets are listed in pairs; dealing them out gives the same."""

import random

import pytest

from tagloom.llm import line_dedup


@pytest.mark.parametrize("most", [256, 12])
def test_lines_of_medium_buckets(spark, monkeypatch, most):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    head = [word() for _ in range(50)]
    lines, want = [], []
    for _ in range(20):
        # of one template, so that unlike lines meet in one bucket; each with a near copy
        tail = [word() for _ in range(14)]
        lines += [" ".join(head + tail), " ".join(head + tail[:-1] + [word()])]
        want += [False, True]
    dealt, deal = [], line_dedup._dealt

    def counted(members, *more):
        dealt.append(members.count())
        return deal(members, *more)

    monkeypatch.setattr(line_dedup, "_dealt", counted)
    monkeypatch.setattr(line_dedup, "MEDIUM", most, raising=False)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert [out[i] == "" for i in range(len(lines))] == want
    assert len(dealt) == 1 and (dealt[0] > 0) == (most == 12)
