"""SimHash near-duplicates by meet-in-the-middle ball hashing: no candidate pair is lost, no bucket is large.

A fingerprint sends out the variants of it within half the radius, and two
fingerprints that are near meet in a variant. Half of 3 is 1 for one of the two
and 2 for the other. Which one is told by the parity of their set bits: an odd
distance lies between an odd and an even fingerprint, and a distance of 2
between two of the same parity. So

* odd fingerprints send out their 64 variants at distance 1,
* even ones themselves and their variants at distance 2 (of three differing bits
  two always lie in the same half, so that flips within a half are enough),
  which meets odd ones at distance 1 and 3, and
* even ones their variants at distance 1 too, to meet each other at distance 2.

All who meet in a variant that an odd fingerprint sent are within the radius of
that one; even ones that meet alone in the third kind are 2 apart. Each member
is therefore linked with the smallest sender of its bucket, verified, and equal
links become one: stars that keep all that is reachable, without pairs of
members. Fingerprints are distinct before they are sent, so a variant has at
most 64 senders at distance 1 and 993 others: no bucket can be hot, however
many copies a text has.

Cases: a null or empty text, or one without words, has fingerprint zero and is
linked like any other; fewer words than a shingle has are one shingle; repeated
rows come out repeated; a row without doc_id gets a row too, and its component
is the smallest doc_id that is not null (null if none is); doc_id may be of any
type that has an order; an empty table gives no rows; further columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Kept, sliced
from .components import components

RADIUS = 3
#: So many shingles at a time are held as 64 bits each, whatever a text's length.
AT_ONCE = 200_000


def fingerprints(texts: pa.Array, width: int) -> np.ndarray:
    """The unsigned 64-bit fingerprint of each text: bits that over half of its shingles' hashes have set."""
    import xxhash

    lowered = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    # white space inside becomes one space each, so that a shingle is a slice of its text
    plain = pc.binary_join(pc.ascii_split_whitespace(lowered), " ").cast(pa.large_string())
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = plain.buffers()[2]
    data = bytes(data)[offsets[0] : offsets[-1]] if data else b""
    offsets = offsets - offsets[0]
    blanks = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    filled = np.flatnonzero(np.diff(offsets))
    begins = np.sort(np.concatenate([offsets[filled], blanks + 1]))
    ends = np.sort(np.concatenate([offsets[filled + 1], blanks]))
    n_words = np.diff(np.searchsorted(begins, offsets))
    n = np.where(n_words > 0, np.maximum(n_words - width + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), n)
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(n_words) - n_words, n)
    last = first + np.minimum(width, n_words[doc]) - 1
    counts = np.zeros((len(n), 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(doc), AT_ONCE):
        cut = slice(at, at + AT_ONCE)
        spans = zip(begins[first[cut]].tolist(), ends[last[cut]].tolist(), strict=True)
        h = np.fromiter((digest(data[a:b], 42) for a, b in spans), np.uint64, len(doc[cut]))
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        owner = doc[cut]
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        counts[owner[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n[:, None], axis=1).view(">u8").astype(np.uint64).reshape(-1)


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            value = fingerprints(batch.column("text"), width).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(value)], names=["doc_id", "fp"])

    return run


def _flips(n: int) -> list[int]:
    """Masks of n set bits, as signed numbers: any one bit, or two within the same half."""
    if n == 0:
        return [0]
    masks = [1 << i for i in range(64)] if n == 1 else [1 << i | 1 << j for h in (0, 32) for i in range(h, h + 32) for j in range(h, i)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _sent(prints: DataFrame, masks: list[int]) -> DataFrame:
    """(variant, fp): each fingerprint with each mask's bits flipped."""
    each = prints.select("fp", F.explode(F.array(*map(F.lit, masks)).cast("array<bigint>")).alias("mask"))
    return each.select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp")


def apart(a: str | Column, b: str | Column) -> Column:
    """The number of bits in which two fingerprints differ."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def star_links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints `fp`, RADIUS bits apart at most, through which all that is near is connected."""
    odd, even = (prints.where(F.bit_count("fp") % 2 == k).select("fp") for k in (1, 0))
    sent = _sent(odd, _flips(1))
    hubs = sent.groupBy("variant").agg(F.min("fp").alias("hub"))
    # the hubs are a small part of what is sent, so each task can hold its share of them as a hash table
    mixed = sent.union(_sent(even, _flips(0) + _flips(2))).join(hubs.hint("shuffle_hash"), "variant")
    sent = _sent(even, _flips(1))
    several = sent.groupBy("variant").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    alike = sent.join(several.hint("merge"), "variant")
    pairs = mixed.select("fp", "hub").union(alike.select("fp", "hub")).where("fp <> hub")
    return pairs.select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct().where(apart("a", "b") <= RADIUS)


def near_components(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    kept = Kept(spark)
    kind = docs.schema["doc_id"].dataType
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())])
    keys = kept.write(docs.mapInArrow(_fingerprints(width), schema))
    # copies are one from here on; few bytes each, but many variants, hence as many tasks as a shuffle has
    prints = kept.write(keys.groupBy("fp").agg(F.min("doc_id").alias("least")))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = kept.write(star_links(prints.select("fp").repartition(tasks, "fp")))
    found = kept.write(components(links, kept))
    kept.drop(links)
    # a component is named by a fingerprint until its smallest doc_id is known
    # merged: fingerprints are few bytes each, but as many as there are different texts, too many for the driver to broadcast
    named = found.join(prints.hint("merge"), found.node == prints.fp).groupBy("component").agg(F.min("least").alias("first"))
    of = found.join(named.hint("merge"), "component").select(F.col("node").alias("fp"), "first")
    of = kept.write(prints.join(of.hint("merge"), "fp", "left").select("fp", F.coalesce("first", "least").alias("component_id")))
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return keys.join(of.hint("merge"), "fp").select("doc_id", fingerprint, "component_id")
