"""Calibrated tags from scores to what changes."""

import random

from tagloom.operators import calibrated as cal

HEADS = "head_name string, kind string, label string, threshold double, high_term string, low_term string"
AGAINST = "label string, other string"


def world(spark, seed=1, n=80):
    rng = random.Random(seed)
    heads = [
        ("energy", "regression", "energy", None, "energetic", "mellow"), ("party", "multiclass", "party", 0.65, None, None), ("party", "multiclass", "non_party", None, None, None),
        ("mood", "multilabel", "happy", None, None, None), ("mood", "multilabel", "not_happy", None, None, None), ("mood", "multilabel", "sad", 0.7, None, None), ("odd", "unknown", "x", None, None, None),
    ]
    stats, scores = [], []
    for f in range(n):
        for h, kind, label, *_ in heads:
            if rng.random() < 0.9:
                stats.append((f, h, label, round(rng.random(), 3), round(rng.random() * 0.3, 3)))
            if kind != "regression" and rng.random() < 0.9:
                scores.append((f, h, label, round(rng.random(), 3)))
    states = [("energy", 0.2, 0.7), ("not_party", 0.1, 0.9), ("happy", 0.5, 0.5)]
    against = [("energetic", "sad"), ("sad", "energetic"), ("party", "mellow"), ("mellow", "party")]
    return {
        "scores": spark.createDataFrame(scores, "file_id long, head_name string, label string, value double"),
        "stats": spark.createDataFrame(stats, "file_id long, head_name string, label string, mean double, std double"),
        "heads": spark.createDataFrame(heads, HEADS),
        "states": spark.createDataFrame(states, "label string, p5 double, p95 double"),
        "against": spark.createDataFrame(against, AGAINST),
    }, (scores, stats, heads, states)


def by_hand(scores, stats, heads, states):
    """All outputs, a file and head at a time."""
    plain = lambda x: "not_" + x[4:] if x.startswith("non_") else x
    state = {x: (a, b) for x, a, b in states}
    value, deviation, mean = {(f, h, x): v for f, h, x, v in scores}, {(f, h, x): s for f, h, x, _, s in stats}, {(f, h, x): m for f, h, x, m, _ in stats}
    out = []

    def scale(v, label):
        a, b = state.get(plain(label), (0, 0))
        return min(max((v - a) / (b - a), 0), 1) if b > a else v

    def span(label):
        a, b = state.get(plain(label), (0, 0))
        return b - a if b > a else 1.0

    for f, h in sorted({(f, h) for f, h, *_ in stats}):
        rows = [r for r in heads if r[0] == h]
        if rows[0][1] == "regression":
            label = rows[0][2]
            m, s = min(max(scale(mean[f, h, label], label), 0), 1), deviation[f, h, label] / span(label)
            far = abs(m - 0.5) * 2
            t = None if s >= 0.25 else "high" if s < 0.08 and far >= 0.8 else "medium" if s < 0.15 and far >= 0.6 else "low"
            high, low = rows[0][4:]
            out += [(f, h, high, m, t)] if m >= 0.7 else [(f, h, low, m, t)] if m <= 0.3 else [(f, h, high, m, None), (f, h, low, 1 - m, None)]
        elif rows[0][1] in cal.CLASSES:
            p = {x: scale(value[f, h, x], x) if (f, h, x) in value else 0.0 for _, _, x, *_ in rows}
            for _, kind, x, least, *_ in rows:
                others = [p[y] for y in p if y != x]
                c = p[f"not_{x}"] if kind == "multilabel" and f"not_{x}" in p else max(others)
                s, t = deviation.get((f, h, x), 0.0) / span(x), None
                for name, low, ratio, gap, unsteady in cal.CASCADE:
                    if t is None and p[x] >= (least if least is not None else 0.6) and p[x] >= low and p[x] / max(c, 1e-9) >= ratio and p[x] - c >= gap and s < unsteady:
                        t = name
                out.append((f, h, x, p[x], t))
    return sorted((f, h, x, round(v, 6), t or "") for f, h, x, v, t in out)


def test_outputs_of_all_kinds_of_heads(spark):
    frames, rows = world(spark)
    got = cal.outputs(*(frames[k] for k in ("scores", "stats", "heads", "states"))).collect()
    assert sorted((r.file_id, r.head_name, r.label, round(r.value, 6), r.tier or "") for r in got) == by_hand(*rows)
    assert {r.model_key for r in got if r.label == "non_party"} == {"party/not_party"}
    assert len({r.tier for r in got}) == 4


def test_only_changed_files_come_out(spark):
    frames, (scores, *_) = world(spark)
    order = ("scores", "stats", "heads", "states", "against")
    tags = cal.calibrated_tags(*(frames[k] for k in order)).cache()
    files = frames["stats"].select("file_id").distinct()
    none = spark.createDataFrame([], "file_id long, content_hash string")
    new, all_tags = cal.changed(tags, files, none)
    assert new.count() == files.count() and all_tags.count() == tags.count() > 0
    stored_tags, stored = (x.cache() for x in cal.written(tags.limit(0), none, new, all_tags))
    assert cal.changed(tags, files, stored)[0].count() == 0
    # one file's score changes so that its moods do
    by_file = {}
    for r in tags.collect():
        by_file.setdefault(r.file_id, set()).add((r.rel, r.moods))
    one = next(f for f in sorted(by_file) if any("happy" in m for _, m in by_file[f]))
    other = spark.createDataFrame([(f, h, x, 0.0 if f == one and x == "happy" else v) for f, h, x, v in scores], frames["scores"].schema)
    again = cal.calibrated_tags(other, *(frames[k] for k in order[1:])).cache()
    new, moved = cal.changed(again, files, stored)
    assert [r.file_id for r in new.collect()] == [one]
    after_tags, after = cal.written(stored_tags, stored, new, moved)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(after_tags) == rows(again) and rows(after) == rows(cal.content_hash(again, files))
    # contradictions: no file has both sides of a pair
    for f, found in by_file.items():
        loose = {m for rel, ms in found if rel == "mood-loose" for m in ms.split("|")}
        assert not {"energetic", "sad"} <= loose and not {"party", "mellow"} <= loose, f


def test_files_that_lose_all_tags_are_cleared(spark):
    frames, _ = world(spark, n=5)
    files = frames["stats"].select("file_id").distinct()
    tags = spark.createDataFrame([(0, "mood-loose", "happy")], "file_id long, rel string, moods string")
    stored = cal.content_hash(tags, files)
    new, out = cal.changed(tags.limit(0), files, stored)
    assert [r.file_id for r in new.collect()] == [0] and out.count() == 0
    assert cal.written(tags, stored, new, out)[0].count() == 0
    assert cal.calibrated_tags(frames["scores"].limit(0), frames["stats"].limit(0), frames["heads"], frames["states"], frames["against"]).count() == 0


