"""Byte-level BPE by monoid tree reduction, and length histograms.

A text's encoding is a monoid element: halves are encoded recursively and
joined. A join re-encodes a window around the seam and keeps the tokens outside.
Windows start and end where white space follows a character that is none: no
match of the pattern spans such a place, whatever stands around it, so that the
tokens outside are those of the whole text; a window grows until it has such a
place on either side, or reaches the end. (A match of the pattern looks at most
at the one character beyond it or the two that a contraction takes, so that the
seam itself is kept at least three characters inside.) Decoding concatenates
the bytes up the same tree.

Cases: a null text counts as empty and has no tokens; very long texts and very
long runs without white space are encoded whole; repeated rows come out
repeated; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, sliced

#: Texts up to so many characters are encoded at once.
LEAF = 1024
#: A window's first reach to either side of a seam, in characters.
REACH = 64
MARGIN = 3
#: White space that every reading of the pattern takes for such.
SEAMS = " \n\r\t"


def vocabulary(path: str, pattern: str):
    """The library's encoder for the ranks at `path`, and each token's bytes. It is built once a task: a cache would be looked up by name, and executors need not have this package."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), tokens


def seam_left(text: str, lo: int, at: int, reach: int) -> int | None:
    """The last place before `at` where white space follows another character, not below `lo` and within reach."""
    for i in range(at - MARGIN, max(lo, at - reach), -1):
        if text[i] in SEAMS and not text[i - 1].isspace():
            return i
    return lo if at - reach <= lo else None


def seam_right(text: str, at: int, hi: int, reach: int) -> int | None:
    for i in range(at + MARGIN, min(hi, at + reach)):
        if text[i] in SEAMS and not text[i - 1].isspace():
            return i
    return hi if at + reach >= hi else None


def tail(ids: list[int], tokens: list[bytes], n_bytes: int) -> int:
    """How many of the last tokens make up so many bytes."""
    k = 0
    while n_bytes > 0:
        k += 1
        n_bytes -= len(tokens[ids[-k]])
    return k


def head(ids: list[int], tokens: list[bytes], n_bytes: int) -> int:
    k = 0
    while n_bytes > 0:
        n_bytes -= len(tokens[ids[k]])
        k += 1
    return k


def encode(text: str, enc, tokens: list[bytes], leaf: int = LEAF, lo: int = 0, hi: int | None = None) -> list[int]:
    """The ids of text[lo:hi] as a text of its own."""
    hi = len(text) if hi is None else hi
    if hi - lo <= max(leaf, 1):
        return enc.encode_ordinary(text[lo:hi])
    at = (lo + hi) // 2
    left, right = encode(text, enc, tokens, leaf, lo, at), encode(text, enc, tokens, leaf, at, hi)
    reach, a, b = REACH, None, None
    while a is None or b is None:
        a = seam_left(text, lo, at, reach) if a is None else a
        b = seam_right(text, at, hi, reach) if b is None else b
        reach *= 2
    out = left[: len(left) - tail(left, tokens, len(text[a:at].encode()))]
    out += enc.encode_ordinary(text[a:b])
    out += right[head(right, tokens, len(text[at:b].encode())) :]
    return out


def decode(ids: list[int], tokens: list[bytes], leaf: int = LEAF) -> bytes:
    if len(ids) <= max(leaf, 1):
        return b"".join(map(tokens.__getitem__, ids))
    half = len(ids) // 2
    return decode(ids[:half], tokens, leaf) + decode(ids[half:], tokens, leaf)


def tokenized(docs: DataFrame, path: str, pattern: str, leaf: int = LEAF, digests: bool = False, ids: bool = False) -> DataFrame:
    """doc_id and n_tokens of each text; with `ids` the ids, with `digests` the hashes of ids and of decoded bytes. A map over the rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tokens = vocabulary(path, pattern)
        for batch in sliced(batches):
            coded = [encode(t or "", enc, tokens, leaf) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array([len(x) for x in coded], pa.int64())]
            if ids:
                columns.append(pa.array(coded, pa.list_(pa.int32())))
            if digests:
                columns.append(pa.array([hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in coded], pa.string()))
                columns.append(pa.array([hashlib.sha256(decode(x, tokens)).hexdigest() for x in coded], pa.string()))
            yield pa.record_batch(columns, names=["doc_id", "n_tokens", *["ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


#: Lengths are summed in blocks of so many, whose totals are then summed: no task holds more than a block, or one row a block.
LENGTHS = 1024


def length_histogram(counted: DataFrame) -> DataFrame:
    """The exact histogram of n_tokens with suffix sums: for each length that occurs, taken as a context limit, how much fits.

    n_docs and n_tokens_total have this length; docs_over and tokens_over are
    longer; truncated_total is what is left when texts are cut at the limit;
    share_within is the share of texts of at most this length, from which
    quantiles follow.
    """
    hist = counted.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs")).withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / LENGTHS))
    # written once: all that follows reads it, and texts are encoded once
    hist = Kept(counted.sparkSession).write(hist)
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    sums = blocks.select("block", F.coalesce(F.sum("block_docs").over(after), zero).alias("d"), F.coalesce(F.sum("block_tokens").over(after), zero).alias("t"), F.sum("block_docs").over(whole).alias("all_docs"))
    inside = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = hist.join(sums, "block").select(
        "length", "n_docs", F.col("tokens").alias("n_tokens_total"),
        (F.coalesce(F.sum("n_docs").over(inside), zero) + F.col("d")).alias("docs_over"),
        (F.coalesce(F.sum("tokens").over(inside), zero) + F.col("t")).alias("tokens_over"),
        "all_docs",
        F.sum("tokens").over(Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)).alias("up_to"),
        "block",
    )
    below = blocks.select("block", F.coalesce(F.sum("block_tokens").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("below"))
    return out.join(below, "block").select(
        "length", "n_docs", "n_tokens_total", "docs_over", "tokens_over",
        (F.col("up_to") + F.col("below") + F.col("length") * F.col("docs_over")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("share_within"),
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: texts that fit, their tokens, and the total when longer ones are cut there."""
    each = histogram.withColumn("limit", F.explode(F.array(*(F.lit(x).cast("long") for x in limits))))
    fits = F.col("length") <= F.col("limit")
    return each.groupBy("limit").agg(F.sum(F.when(fits, F.col("n_docs")).otherwise(0)).alias("docs_within"), F.sum(F.when(fits, F.col("n_tokens_total")).otherwise(0)).alias("tokens_within"), F.sum(F.least("length", "limit") * F.col("n_docs")).alias("truncated_total"))


def quantiles(histogram: DataFrame, at: list[float]) -> DataFrame:
    """The smallest length within which so large a share of the texts lies."""
    each = histogram.withColumn("q", F.explode(F.array(*(F.lit(float(x)) for x in at))))
    return each.where(F.col("share_within") >= F.col("q")).groupBy("q").agg(F.min("length").alias("length"))
