"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words of letters and digits (and of anything beyond ASCII) in lower-cased text.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"
#: What parts words in text as it is: ASCII white space.
SPACES = r"[\x20\x09-\x0D]++"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case; other letters stay, so that no character outside ASCII turns into one inside.

    Text that is ASCII throughout, seen from its lengths, takes the faster `lower`.
    """
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_of(c: str = "text") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def split_words(c: Column, between: str) -> Column:
    """The words of a text in order. Splitting is linear; extracting matches copies the text for each of them."""
    return F.array_remove(F.split(c, between), "")


def words(c: Column) -> Column:
    """The words of lower-cased text, in order."""
    return split_words(ascii_lower(c), BETWEEN_WORDS)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: 64-bit words of a sieve: the table that every executor gets has no more rows, however much is looked for.
SIEVE = 1 << 19


def sieve(df: DataFrame, key: str, wanted: DataFrame, of: str) -> DataFrame:
    """The rows of `df` whose 64-bit hash `key` may be among `wanted`'s `of`; some others pass, none is lost.

    A table of bits, of bounded size, is broadcast, so that few of the rows that
    an exact join is to find are shuffled for nothing. When very much is looked
    for, most bits are set and more rows pass.
    """
    place = lambda h: F.pmod(F.shiftright(h, 6), F.lit(SIEVE))
    slot, bits = fresh(df, "slot"), fresh(df, "bits")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(of).bitwiseAND(F.lit(63)).cast("int"))
    table = wanted.select(place(F.col(of)).alias(slot), bit.alias("bit")).groupBy(slot).agg(F.bit_or("bit").alias(bits))
    met = df.withColumn(slot, place(F.col(key))).join(F.broadcast(table), slot)
    hit = F.call_function("shiftrightunsigned", F.col(bits), F.col(key).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return met.where(hit).select(*(F.col(f"`{c}`") for c in df.columns))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where none is set, a temporary one is made if all runs on this machine
    (tests); on a cluster executors would each write to a disk of their own, so
    that an error is raised.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tagloom-")
        sc.setCheckpointDir(at)
    return at


class Kept:
    """Tables written below the shared folder to cut lineage: lost executors take nothing with them.

    `drop` deletes those that nothing lazy reads any more; the rest goes when
    the driver's Python ends, as results may be read until then.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        # not a bound method, which would keep all DataFrames and their plans
        atexit.register(_end, spark, self.root)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            _delete(self.spark, self.paths.pop(id(df))[1])


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _end(spark: SparkSession, root: str) -> None:
    # a session that has been stopped has no file systems any more
    if spark.sparkContext._jsc is not None:
        _delete(spark, root)


def sliced(batches: Iterator[pa.RecordBatch], most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about so many bytes: memory stays bounded whatever the lengths of the texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Mapper) -> Mapper:
    """The same, and at its end the task's memory goes back to the system: Python's workers live on, and what one stage keeps would be added to the next one's."""

    def then_free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim:
            trim(0)

    return then_free
