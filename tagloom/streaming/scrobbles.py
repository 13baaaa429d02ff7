"""Play events: repeats within a window of the last accepted play are dropped, the others counted. Times before 1970 are no plays.

A stream takes events in the order of their times, as far as they come within
`delay` of the latest: it holds a key's events until the watermark has passed
them. What comes later still (and, in a stream, the moment 0 itself) is dropped, as an event behind the last accepted
one is. So stream and table agree on any order of the same events, but for those
that are too late. A key's state holds what the watermark has not passed and the
last accepted time, and goes when no event to come can be a repeat.

Accepted plays go into a table of increments, one folder a batch that appears by
one rename: a batch that runs again finds its folder there and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.storage import Folder, Versions

WINDOW_MS = 30_000
COUNTS = ("playcount", "last_played")


def accept(last: int, count: int, times: list[int]) -> tuple[int, int]:
    """The last accepted time and the count after these events: one counts only if it is WINDOW_MS or more after the last accepted."""
    for t in times:
        if last < 0 or t - last >= WINDOW_MS:
            last, count = t, count + 1
    return last, count


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Accepts what the watermark has passed, and keeps the rest."""
    last, held = state.get if state.exists else (-1, [])
    held = sorted({*held, *(int(t) for f in frames for t in f["ts_ms"])})
    passed = state.getCurrentWatermarkMs()
    before = last
    last, count = accept(last, 0, [t for t in held if t <= passed])
    held = [t for t in held if t > passed]
    # woken up when the first event held can be told, or when the last accepted one can have no repeats any more
    wake = held[0] if held else last + WINDOW_MS
    if wake > passed and (held or last >= 0):
        state.update((last, held))
        state.setTimeoutTimestamp(wake)
    elif state.exists:
        state.remove()
    n = int(last != before)
    yield pd.DataFrame({"user_id": [key[0]] * n, "nd_id": [key[1]] * n, "playcount": [count] * n, "last_played": [last] * n})


def accepted_plays(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Of a stream of events (user_id, nd_id, ts_ms) the plays to add (user_id, nd_id, playcount, last_played), in append mode."""
    kinds = [T.StructField(c, events.schema[c].dataType) for c in ("user_id", "nd_id")]
    out = T.StructType([*kinds, *(T.StructField(c, T.LongType()) for c in COUNTS)])
    timed = events.where("ts_ms >= 0").select("user_id", "nd_id", F.col("ts_ms").cast("long").alias("ts_ms")).withColumn("ts", F.timestamp_millis("ts_ms"))
    grouped = timed.withWatermark("ts", delay).groupBy("user_id", "nd_id")
    return grouped.applyInPandasWithState(_advance, out, "last long, held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


class PlaysTable:
    """Counts of plays by user and track in a folder: a base, and an increment for each batch of a stream since."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.folder = spark, Folder(spark, at)
        self.base = Versions(spark, f"{self.folder.at}/base")

    def _folded(self, version: int) -> int:
        """The last batch that a version of the base holds; -1 before the first."""
        return self.base.read("about", version).first().batch if version else -1

    def add(self, plays: DataFrame, batch: int) -> None:
        """For foreachBatch. A batch that has been added is not added again."""
        name = f"increments/batch={batch}"
        if batch <= self._folded(self.base.latest()) or f"batch={batch}" in self.folder.names("increments"):
            return
        draft = f"drafts/batch={batch}"
        plays.write.mode("overwrite").parquet(f"{self.folder.at}/{draft}")
        self.folder.rename(draft, name)

    def read(self) -> DataFrame | None:
        """user_id, nd_id, playcount and last_played; None before the first batch."""
        version = self.base.latest()
        last = self._folded(version)
        parts = [self.base.read("plays", version)] if version else []
        parts += [self.spark.read.parquet(f"{self.folder.at}/increments/{n}") for n in self.folder.names("increments") if int(n.removeprefix("batch=")) > last]
        if not parts:
            return None
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.groupBy("user_id", "nd_id").agg(F.sum("playcount").alias("playcount"), F.max("last_played").alias("last_played"))

    def compact(self) -> None:
        """Folds the increments into a new base; readers see the old or the new. Increments that a base holds are deleted afterwards."""
        version = self.base.latest()
        last = self._folded(version)
        batches = [int(n.removeprefix("batch=")) for n in self.folder.names("increments")]
        if max(batches, default=-1) > last:
            about = self.spark.range(1).select(F.lit(max(batches)).cast("long").alias("batch"))
            self.base.publish(version + 1, plays=self.read(), about=about)
        for b in batches:
            self.folder.delete(f"increments/batch={b}")


def count_plays(events: DataFrame, table: PlaysTable, checkpoint: str, delay: str = "1 minute"):
    """A writer that keeps `table` up to date with a stream of events; start it with the trigger you want."""
    return accepted_plays(events, delay).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(table.add)


def play_counts(events: DataFrame) -> DataFrame:
    """The running counts of a stream (user_id, nd_id, ts_ms) in update mode, for a stream that is in order: nothing is held back, so that state stays for good."""
    return events.where("ts_ms >= 0").groupBy("user_id", "nd_id").applyInPandasWithState(_update, RESULT, "last long, count long", "update", GroupStateTimeout.NoTimeout)


RESULT = "user_id long, nd_id long, playcount long, last_played long"


def _update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, count = state.get if state.exists else (-1, 0)
    for f in frames:
        last, count = accept(last, count, f.ts_ms.sort_values().tolist())
    state.update((last, count))
    yield pd.DataFrame({"user_id": [key[0]], "nd_id": [key[1]], "playcount": [count], "last_played": [last]})


def play_counts_batch(events: DataFrame) -> DataFrame:
    """The same for a table, in the order of time; no Python.

    After a pause of WINDOW_MS the next event counts whatever went before, so
    that a key's events are cut there and each piece is folded by itself: no
    key's events are held whole.
    """
    w = Window.partitionBy("user_id", "nd_id").orderBy("ts_ms")
    pause = F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(w) >= WINDOW_MS, F.lit(True)).cast("int")
    pieces = events.where("ts_ms >= 0").withColumn("pause", pause).withColumn("piece", F.sum("pause").over(w))
    own = pieces.groupBy("user_id", "nd_id", "piece").agg(F.array_sort(F.collect_list("ts_ms")).alias("ts"))
    zero = F.struct(F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("count"))
    fold = F.aggregate("ts", zero, lambda s, t: F.when((s["last"] < 0) | (t - s["last"] >= WINDOW_MS), F.struct(t.alias("last"), (s["count"] + 1).alias("count"))).otherwise(s))
    each = own.select("user_id", "nd_id", fold.alias("s"))
    return each.groupBy("user_id", "nd_id").agg(F.sum("s.count").alias("playcount"), F.max("s.last").alias("last_played"))
