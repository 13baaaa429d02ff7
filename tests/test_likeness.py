"""Likeness against all pairs, whatever the texts."""

import random

import numpy as np

from tagloom.functions.texts import plain
from tagloom.operators import likeness, matching


def all_pairs(asked, lib):
    """What `fuzzy` says, by comparing everything."""
    out = {}
    for i, _, t, a in asked:
        each = sorted((-round(0.7 * matching.token_sort_ratio(plain(t or ""), plain(u or "")) + 0.3 * matching.token_sort_ratio(plain(a or "").removeprefix("the "), plain(b or "").removeprefix("the ")), 6), j) for j, _, u, b in lib)
        each = [x for x in each if -x[0] >= matching.LOW][:4]
        if not each:
            out[i] = ("not_found", 0.0, None, "")
            continue
        near = len(each) > 1 and each[1][0] - each[0][0] < matching.GAP
        status = "fuzzy" if -each[0][0] >= matching.HIGH and not near else "ambiguous"
        out[i] = (status, round(-each[0][0] / 100, 6), each[0][1], ",".join(str(j) for _, j in each[1:]) if near else "")
    return out


def test_equals_all_pairs_on_random_short_and_repetitive_titles(spark, monkeypatch):
    monkeypatch.setattr(likeness, "ASKED", 40)
    monkeypatch.setattr(likeness, "HELD", 70)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    lib = [(i, None, " ".join(word() for _ in range(rng.randint(1, 4))), word()) for i in range(120)]
    lib += [(200 + i, None, "la " * rng.randint(1, 12) + rng.choice(["", "x", "love"]), rng.choice(["Abba", "The Abba", "Baab"])) for i in range(60)]
    lib += [(300 + i, None, rng.choice("abcde"), rng.choice("ab")) for i in range(40)]
    lib += [(400, None, None, None), (401, None, "", "x"), (402, None, "é" * 300 + "ab", "ß"), (403, None, "same words here", "one"), (404, None, "here same words", "one"), (405, None, "word " * 80, "long")]
    asked = []
    for i, _, t, a in rng.sample(lib, 110):
        t, a = t or "", a or ""
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(["", "q", " "]) + t[at + rng.randint(0, 1) :]
        asked.append((len(asked), None, t, rng.choice([a, a + "s", "other"])))
    asked += [(500, None, None, None), (501, None, "é" * 290 + "ba", "ß"), (502, None, "words here same", "one"), (503, None, "word " * 79 + "ward", "long")]
    cols = "isrc string, title string, artist string"
    frames = spark.createDataFrame(asked, f"track_id long, {cols}"), spark.createDataFrame(lib, f"file_id long, {cols}")
    got = {r.track_id: (r.status, r.confidence, r.file_id, r.alternatives) for r in matching.fuzzy(*frames).collect()}
    assert got == all_pairs(asked, lib)
    assert {r.track_id for r in matching.fuzzy(frames[0], frames[1].limit(0)).collect()} == set(got)
    assert matching.fuzzy(frames[0].limit(0), frames[1]).collect() == []


def test_common_subsequences_of_many_at_once():
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcé 日") for _ in range(rng.randint(0, n)))
    for n in (0, 1, 5, 63, 64, 65, 90):
        a, others = "".join(rng.choice("abcé 日") for _ in range(n)), [text(80) for _ in range(30)]
        points = np.zeros((30, 80), np.int64)
        for i, t in enumerate(others):
            points[i, : len(t)] = [ord(x) for x in t]
        assert likeness.common_subsequences(a, points).tolist() == [likeness.common_subsequence(a, t) for t in others]


def test_matches_of_all_kinds(spark):
    cols = "isrc string, title string, artist string"
    lib = spark.createDataFrame([(1, "X1", "First Song", "Someone"), (2, None, "Second Song", "Someone"), (3, None, "Another Melody", "Nobody")], f"file_id long, {cols}")
    ask = spark.createDataFrame([(1, "X1", "?", "?"), (2, None, "second song (Live)", "The Someone"), (3, None, "Anothr Melody", "Nobody"), (4, None, "zzz", "qqq")], f"track_id long, {cols}")
    got = {r.track_id: (r.status, r.file_id) for r in matching.match_all(ask, lib).collect()}
    assert got == {1: ("isrc", 1), 2: ("exact", 2), 3: ("fuzzy", 3), 4: ("not_found", None)}
    assert {r.status: r.n_tracks for r in matching.status_counts(matching.match_all(ask, lib)).collect()} == {"isrc": 1, "exact": 1, "fuzzy": 1, "not_found": 1}
