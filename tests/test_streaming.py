import datetime
import os
import random

import pytest

from tagloom.sources.storage import Folder
from tagloom.streaming.changes import due_scans, trigger_scans
from tagloom.streaming.scrobbles import PlaysTable, accept, count_plays, play_counts, play_counts_batch

TIMES = [0, 10_000, 29_999, 30_000, 20_000]


def test_only_first_and_those_after_the_window():
    assert accept(-1, 0, sorted(TIMES)) == (30_000, 2)


def test_batch_and_stream_agree(spark, tmp_path):
    rows = [(1, 7, t) for t in TIMES] + [(2, 7, 5), (2, 7, 60_000)]
    events = spark.createDataFrame(rows, "user_id long, nd_id long, ts_ms long")
    want = {tuple(r) for r in play_counts_batch(events).collect()}
    assert want == {(1, 7, 2, 30_000), (2, 7, 2, 60_000)}
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = play_counts(stream).writeStream.format("memory").queryName("counts").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("counts").collect()} == want


def _batches(spark, tmp_path, name, rows, schema, sizes):
    """Files of a stream, one a micro-batch, in the order of the rows."""
    at = tmp_path / name
    n = 0
    for k, size in enumerate(sizes):
        part = rows[n : n + size]
        n += size
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(at))
        newest = max(at.glob("part-*"), key=lambda p: p.stat().st_mtime_ns)
        os.utime(newest, (1_000_000 + k, 1_000_000 + k))
    assert n == len(rows)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(at))


EVENTS = "user_id string, nd_id long, ts_ms long"


def test_stream_agrees_with_batch_on_events_that_come_in_any_order(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"u{rng.randint(0, 2)}", rng.randint(0, 1), t * 1000) for t in range(1_000, 2_200, 3)]
    # each event comes up to 100 s late
    rows = sorted(rows, key=lambda r: r[2] + rng.randint(0, 100_000)) + [("u0", 0, -5), ("u0", 0, 10_000_000)]  # the last one moves the watermark
    stream = _batches(spark, tmp_path, "in", rows, EVENTS, [60] * 6 + [41, 1])
    table = PlaysTable(spark, str(tmp_path / "plays"))
    assert table.read() is None
    states = []
    for _ in range(2):  # the second run finds nothing new
        q = count_plays(stream, table, str(tmp_path / "cp"), "101 seconds").trigger(availableNow=True).start()
        q.awaitTermination(300)
        states += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    want = {tuple(r) for r in play_counts_batch(spark.createDataFrame(rows[:-1], EVENTS)).collect()}
    assert {tuple(r) for r in table.read().collect()} == want
    # all but the key whose last event has come just now is forgotten
    assert max(states) == 6 and states[-1] == 1
    # a batch that runs again changes nothing, before and after it is folded into the base
    numbers = [int(n.removeprefix("batch=")) for n in table.folder.names("increments")]
    again = spark.createDataFrame([("u0", 0, 5, 5)], "user_id string, nd_id long, playcount long, last_played long")
    table.add(again, max(numbers))
    table.compact()
    table.add(again, max(numbers))
    assert {tuple(r) for r in table.read().collect()} == want and table.folder.names("increments") == []
    table.add(again, max(numbers) + 1)
    assert sum(r.playcount for r in table.read().collect()) == sum(w[2] for w in want) + 5


def test_late_events_are_dropped(spark, tmp_path):
    rows = [("u", 1, 5), ("u", 1, 100_000), ("u", 1, 300_000), ("u", 1, 340_000), ("u", 1, 150_000), ("u", 1, 900_000)]
    stream = _batches(spark, tmp_path, "in", rows, EVENTS, [1] * 6)
    table = PlaysTable(spark, str(tmp_path / "plays"))
    count_plays(stream, table, str(tmp_path / "cp"), "10 seconds").trigger(availableNow=True).start().awaitTermination(300)
    assert [tuple(r) for r in table.read().collect()] == [("u", 1, 4, 340_000)]


def test_one_scan_a_burst_across_batches_and_restarts(spark, tmp_path):
    at = lambda s: datetime.datetime.fromtimestamp(1_700_000_000 + s, datetime.UTC).replace(tzinfo=None)
    rows = [(1, at(0)), (1, at(1)), (2, at(1)), (1, at(2)), (1, at(2)), (1, at(20)), (2, at(21)), (None, at(22)), (3, at(60))]
    schema = "library_id long, ts timestamp"
    stream = _batches(spark, tmp_path, "in", rows, schema, [2, 2, 2, 2, 1])
    seen = []
    folder = Folder(spark, str(tmp_path / "marks"))

    def run(fail_at=None):
        def scan(libraries, batch):
            if batch == fail_at:
                raise RuntimeError("lost")
            seen.extend(libraries)

        return trigger_scans(stream, scan, folder, str(tmp_path / "cp"), "3 seconds", "1 second").trigger(availableNow=True).start()

    with pytest.raises(Exception):
        run(fail_at=next_due(spark, stream, tmp_path)).awaitTermination(300)
    run().awaitTermination(300)
    run().awaitTermination(300)
    assert sorted(seen) == [1, 1, 2, 2]


def next_due(spark, stream, tmp_path):
    """The first batch in which a scan is due."""
    found = []
    q = due_scans(stream, "3 seconds", "1 second").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "look")).foreachBatch(lambda df, b: found.append(b) if df.count() else None)
    q.trigger(availableNow=True).start().awaitTermination(300)
    return found[0]
