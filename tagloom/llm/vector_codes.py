"""Vectors as eight one-byte codes: product quantisation in integers, with codebooks from Lloyd's rounds over all vectors.

Components become integers, so that sums, means and distances are exact and the
same in whatever order tasks add them. In each round tasks assign the parts of
their vectors and sum them up; Spark adds these sums, and the driver gets one
row for each component of each entry (16 entries times the dimension, however
many vectors there are), from which it makes the next codebooks.

A part's nearest entry is found from coarse to fine. With means over blocks of a
part, sum(len * (mean - mean')^2) + (rest - rest')^2 is never above the squared
distance, where a part's rest is the norm of what its block means leave over.
The exact distance of the entry with the least coarse bound is the one to beat:
what has a larger bound, with a margin for rounding, goes out, at one block, at
two, at four, ...; survivors get their exact integer distance. Entries with
equal distances survive together, and the one of lower index is taken.

Cases: a vector that is null or holds null, NaN or an infinite component is left
out. So is one whose length is not a positive multiple of eight, or is not the
commonest such length (of equally common ones the shortest), as parts of other
lengths have no distance, and one whose components are so large that a squared
distance might not fit 64 bits (for 64 dimensions from 46,340 on). A repeated
vec_id gives a row each time, but seeds once, by its smallest vector; rows
without vec_id are coded, yet don't seed. With fewer than 16 vec_ids the
codebooks have as many entries. label_error is null where it does not fit a
long. An empty table gives no rows. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Kept, sliced

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bounds are floats; what they rule out they must exceed by this share, far above their rounding errors.
MARGIN = 1e-9


def _blocks(width: int) -> list[np.ndarray]:
    """Where the blocks of each level begin: one block, two, four, ..., as long as a block has two components or more."""
    levels, n = [np.zeros(1, np.int64)], 2
    while 2 * n <= width:
        levels.append(np.arange(n) * width // n)
        n *= 2
    return levels


def _coarse(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: its blocks' means times the root of their lengths, and between what its rest's norm lies."""
    length = np.diff(np.append(starts, x.shape[1])).astype(float)
    scaled = np.add.reduceat(x, starts, axis=1) / np.sqrt(length)
    whole = (x.astype(float) ** 2).sum(axis=1)
    rest, off = whole - (scaled**2).sum(axis=1), 1e-12 * whole
    return scaled, np.sqrt(np.maximum(rest - off, 0)), np.sqrt(np.maximum(rest + off, 0))


def _exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(axis=1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of integers its nearest entry's index (the lower of equals) and the squared distance."""
    n, k = len(x), len(entries)
    row, entry = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    beat = None
    for starts in _blocks(x.shape[1]):
        (sx, low, high), (sc, low_c, high_c) = _coarse(x, starts), _coarse(entries, starts)
        gap = np.maximum(np.maximum(low[row] - high_c[entry], low_c[entry] - high[row]), 0)
        bound = ((sx[row] - sc[entry]) ** 2).sum(axis=1) + gap**2
        if beat is None:
            beat = _exact(x, entries[bound.reshape(n, k).argmin(axis=1)]) if n else np.zeros(0, np.int64)
        stays = bound * (1 - MARGIN) - 1 <= beat[row]
        row, entry = row[stays], entry[stays]
    distances = np.full((n, k), np.iinfo(np.int64).max)
    distances[row, entry] = _exact(x[row], entries[entry])
    best = distances.argmin(axis=1) if n else np.zeros(0, np.int64)
    return best, distances[np.arange(n), best]


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    column = batch.column("v")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), PARTS, width)


def _sums(books: np.ndarray):
    """What a task's vectors add up to for each entry: one row a component, however many vectors it has."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in sliced(batches):
            x = _vectors(batch, width)
            for p in range(parts):
                best, _ = nearest(x[:, p], books[p])
                n[p] += np.bincount(best, minlength=k)
                np.add.at(total[p], best, x[:, p])
        part, entry, place = (a.reshape(-1) for a in np.indices(total.shape))
        used = n[part, entry] > 0
        columns = (part, entry, place, n[part, entry], total.reshape(-1))
        yield pa.record_batch([pa.array(c[used]) for c in columns], names=["part", "entry", "place", "n", "total"])

    return run


def _codes(books: np.ndarray):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = _vectors(batch, width)
            found = [nearest(x[:, p], books[p]) for p in range(parts)]
            code = np.stack([best for best, _ in found], axis=1).astype(np.uint8)
            error = sum(distance for _, distance in found)
            text = pa.array([c.tobytes().hex() for c in code], pa.string())
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), text, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the vector `v` in integers of the rows that can be coded; see the module's cases."""
    v = F.col("embedding").cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select("vec_id", "label", v.alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", odd))
    sizes = rows.where(f"size(v) > 0 AND size(v) % {PARTS} = 0").groupBy(F.size("v").alias("n")).count()
    common = sizes.orderBy(F.desc("count"), "n").limit(1).first()
    n = common.n if common else PARTS
    # two components differ by less than twice the largest, so that n squares of what they differ by still fit
    largest = math.isqrt((2**63 - 1) // n) // 2
    floors = F.transform("v", lambda x: F.floor(F.lit(float(SCALE)) * x))
    fits = lambda x: F.abs(F.lit(float(SCALE)) * x) < largest
    return rows.where(F.size("v") == n).where(F.forall("v", fits)).select("vec_id", "label", floors.cast("array<int>").alias("v"))


def seeds(rows: DataFrame) -> np.ndarray:
    """The first codebooks, [part, entry, component]: the parts of the smallest vec_ids."""
    ids = [r.vec_id for r in rows.where("vec_id IS NOT NULL").select("vec_id").distinct().orderBy("vec_id").limit(ENTRIES).collect()]
    first = rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect() if ids else []
    return np.array([r.v for r in first], np.int64).reshape(len(first), PARTS, -1 if first else 1).transpose(1, 0, 2)


def learn(rows: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after so many rounds over all rows; entries that no part is assigned to stay as they are."""
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(_sums(books), "part long, entry long, place long, n long, total long")
        wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        books = books.copy()
        for r in sums.groupBy("part", "entry", "place").agg(wide("n"), wide("total")).collect():
            books[r.part, r.entry, r.place] = int(r.total) // int(r.n)
    return books


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of the rows of `vectors` (vec_id, embedding, label) that can be coded."""
    kept = Kept(vectors.sparkSession)
    rows = kept.write(integers(vectors))
    books = seeds(rows)
    if books.shape[1]:
        books = learn(rows, books)
    elif not rows.isEmpty():
        raise ValueError("no row has a vec_id: nothing can seed the codebooks")
    kinds = rows.schema
    schema = T.StructType([kinds["vec_id"], kinds["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = kept.write(rows.mapInArrow(_codes(books), schema))
    kept.drop(rows)
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    joined = coded.join(sums, coded.label.eqNullSafe(sums.of))
    return joined.select("vec_id", "code", "error", F.col("total").try_cast("long").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
