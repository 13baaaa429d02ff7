"""Documents as files, a player's inventory as a log of changes, pooling with NaN."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import playlists, scores, sync
from tagloom.sources.documents import write_documents


def below(at):
    return sorted(os.path.relpath(os.path.join(d, f), at) for d, _, fs in os.walk(at) for f in fs)


def test_one_file_a_playlist_with_header_and_order(spark, tmp_path):
    lists = spark.createDataFrame([(1, "A/B: best?", "http://x", "player"), (2, "A_B_ best_", None, None), (3, " .. ", None, None), (4, "leer", None, "other"), (5, None, None, None)], "playlist_id long, name string, source_url string, platform string")
    rng = random.Random(1)
    rows = [(1, i, "exact", f"p/{i}.mp3", i * 1000 + 999, f"artist {i}", f"title\n{i}") for i in range(3000)]
    rows += [(2, 1, "ambiguous", "no", 1, "a", "t"), (2, 2, "fuzzy", "yes.mp3", None, None, "t"), (2, 0, "isrc", "first.mp3", 0, "é", None), (2, 3, "not_found", None, 1, "a", "t"), (9, 1, "exact", "nobody's", 1, "a", "t")]
    rng.shuffle(rows)
    entries = spark.createDataFrame(rows, "playlist_id long, nth long, status string, path string, duration_ms long, artist string, title string").repartition(7)
    at = tmp_path / "out"
    at.mkdir()
    (at / "leer.m3u").write_text("old")
    (at / "other.txt").write_text("stays")
    write_documents(playlists.m3u_documents(lists, entries), str(at))
    assert below(at) == ["A_B_ best_ (2).m3u", "A_B_ best_.m3u", "leer.m3u", "other.txt", "playlist (2).m3u", "playlist.m3u"]
    got = (at / "A_B_ best_.m3u").read_text().split("\n")
    assert got[:5] == ["#EXTM3U", "#PLAYLIST:A/B: best?", "# Source: http://x", "# Converted from player", ""]
    assert got[5:] == [x for i in range(3000) for x in (f"#EXTINF:{i},artist {i} - title {i}", f"p/{i}.mp3")] + [""]
    assert (at / "A_B_ best_ (2).m3u").read_text() == "#EXTM3U\n#PLAYLIST:A_B_ best_\n#EXTINF:-1,é - \nfirst.mp3\n#EXTINF:-1, - t\nyes.mp3\n"
    assert (at / "leer.m3u").read_text() == "#EXTM3U\n#PLAYLIST:leer\n# Converted from other\n\n"
    write_documents(playlists.m3u_documents(lists.limit(0), entries.limit(0)), str(at))
    assert len(below(at)) == 6


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    at = tmp_path / "out"
    fails = F.udf(lambda i: 1 // (i - 77) and f"line {i}", "string")
    lines = spark.range(200).select((F.col("id") % 5).cast("string").alias("document"), F.col("id").alias("nth"), fails("id").alias("line"))
    with pytest.raises(Exception):
        write_documents(lines, str(at))
    assert not at.exists() or below(at) == []
    with pytest.raises(Exception):
        write_documents(lines.limit(1).withColumns({"document": F.lit("../x"), "line": F.lit("x")}), str(at))
    assert below(tmp_path) == []


def test_sidecars_stand_beside_their_models(spark, tmp_path):
    states = spark.createDataFrame([("h1", "happy", 0.1, 0.9), ("h1", "not_happy", 0.0, 1.0), ("h2", "é", 0.2, 0.8), ("h9", "x", 0.0, 1.0)], "head_name string, label string, p5 double, p95 double")
    heads = spark.createDataFrame([("h1", "effnet/heads/mood.v1.onnx", "multiclass", "effnet"), ("h2", "b.onnx", "regression", "b"), ("h3", "none.onnx", "x", "y")], "head_name string, model string, head_type string, backbone string")
    write_documents(playlists.sidecars(states, heads, 3, 500), str(tmp_path))
    assert below(tmp_path) == ["b-calibration-v3.json", "effnet/heads/mood.v1-calibration-v3.json"]
    got = json.loads((tmp_path / "effnet/heads/mood.v1-calibration-v3.json").read_text())
    assert got == {"calibration_version": 3, "calibration_method": "minmax", "library_size": 500, "min_samples": 1000, "model": "mood.v1", "head_type": "multiclass", "backbone": "effnet", "labels": {"happy": {"p5": 0.1, "p95": 0.9}, "not_happy": {"p5": 0.0, "p95": 1.0}}}


SONGS = "nd_id string, nd_path string, play_count long, last_played_ms long"
PLAYS = "user_id long, nd_id string, playcount long, last_played long"


def test_a_sync_leads_to_the_target_and_then_finds_nothing(spark):
    files = spark.createDataFrame([(1, "a/1.mp3"), (2, "a/2.mp3"), (3, "b/3.mp3"), (13, "b/3.mp3")], "file_id long, normalized_path string")
    songs = spark.createDataFrame([("n1", "/music/a/1.mp3", 5, 50), ("n2", "/music/a/2.mp3", 0, None), ("n3", "/music/b/3.mp3", 2, 20), ("n4", "/music/gone.mp3", 1, 10), ("n5", None, 0, 0), ("n1", "/music/a/1.mp3", 4, 60), (None, "/music/a/1.mp3", 1, 1)], SONGS)
    prefix = sync.detect_prefix(songs, files)
    assert prefix == "/music/" and sync.detect_prefix(songs, files.limit(0)) is None
    tracks = spark.createDataFrame([("n1",), ("n3",), ("old",), ("n4",)], "nd_id string")
    links = spark.createDataFrame([("n1", 1), ("n3", 9), ("old", 4), ("n4", 7)], "nd_id string, file_id long")
    plays = spark.createDataFrame([(1, "n1", 3, 30), (1, "n2", 8, 80), (1, "old", 1, 1), (2, "old", 6, 6), (2, "n1", 7, 7), (1, "n3", 2, 20)], PLAYS)
    wanted = sync.target(songs, files, prefix)
    log = sync.changes(wanted, 1, tracks, links, plays).cache()
    assert sorted((r.entity, r.action, r.nd_id, r.user_id or 0) for r in log.collect()) == [
        ("link", "delete", "old", 0), ("link", "insert", "n2", 0), ("link", "update", "n3", 0),
        ("play", "delete", "n2", 1), ("play", "delete", "old", 1), ("play", "delete", "old", 2), ("play", "insert", "n4", 1), ("play", "update", "n1", 1),
        ("track", "delete", "old", 0), ("track", "insert", "n2", 0), ("track", "insert", "n5", 0),
    ]
    r = log.where("entity = 'play' AND action = 'update'").first()
    assert (r.old_count, r.new_count, r.old_last, r.new_last) == (3, 5, 30, 60)
    after = sync.applied(log, tracks, links, plays)
    state = lambda t: {k: sorted(tuple(r) for r in t[k].collect()) for k in t}
    assert state(after) == {
        "tracks": [("n1",), ("n2",), ("n3",), ("n4",), ("n5",)],
        "links": [("n1", 1), ("n2", 2), ("n3", 3), ("n4", 7)],
        "plays": [(1, "n1", 5, 60), (1, "n3", 2, 20), (1, "n4", 1, 10), (2, "n1", 7, 7)],
    }
    assert state(sync.applied(log, **after)) == state(after)
    assert sync.changes(wanted, 1, **after).count() == 0
    assert {(r.entity, r.action): r.n for r in sync.summary(log).collect()}["play", "delete"] == 3


def test_pooling_follows_numpy(spark):
    rng = np.random.default_rng(2)
    files = {}
    for f in range(12):
        a = rng.random((rng.integers(1, 24), 4))
        a[rng.random(a.shape) < 0.25 * (f % 3)] = np.nan
        a[:, 3] = np.nan if f % 4 == 0 else a[:, 3]
        files[f] = a
    df = spark.createDataFrame([(f, [None if np.isnan(x) and f % 2 else float(x) for x in row]) for f, a in files.items() for row in a], "file_id long, scores array<double>")

    def trimmed(col, trim):
        some, cut = np.sort(col[~np.isnan(col)]), int(np.floor(trim * len(col)))
        return 0.0 if not len(some) else np.mean(some[cut : len(some) - cut] if len(some) - cut > cut else some)

    for mode in ("mean", "median", "trimmed_mean"):
        for omit in (True, False):
            got = {(r.file_id, r.dim): r.value for r in scores.pool_scores(df, mode, 0.2, omit).collect()}
            for f, a in files.items():
                for d in range(4):
                    col = a[:, d]
                    some = col[~np.isnan(col)] if omit else col
                    want = trimmed(col, 0.2) if mode == "trimmed_mean" else 0.0 if not len(some) else getattr(np, mode)(some)
                    assert got[f, d] == pytest.approx(want, nan_ok=True), (mode, omit, f, d)
    for bad in ({"mode": "max"}, {"trim": 0.5}):
        with pytest.raises(ValueError):
            scores.pool_scores(df, **bad)
