"""The corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from tagloom.llm.common import Kept, table
from tagloom.llm.queries import tokenizer


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more go, whatever else they are; those with null or empty text have the score of no words. Without labels of both kinds none goes."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near lines stay in the first document that has them; a document whose lines all go stays, with empty text. Rows without doc_id are left as they are."""
    return line_dedup.dedup_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near texts the row with the smallest doc_id stays. Rows without doc_id, and texts without words, stay."""
    return ngram_join.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark's window occurs go; null texts have none. Without items none goes."""
    return decontaminate.clean_only(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and their digests; a null text is encoded as an empty one."""
    return bpe.tokenized(docs, *tokenizer(), ids=True, digests=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_stage),
    ("decontamination", benchmark_stage),
    ("bpe", bpe_stage),
]
#: Training, minima of hashes and BPE have no SQL; tests hold each stage's operator against brute force, and the stages against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Between stages tables are written to the folder that all executors share, and read again.

    A stage's table goes when the next one has been written; the last one when
    the driver's Python ends.
    """
    kept = Kept(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = kept.write(stage(spark, docs, sf_dir))
        if before is not None:
            kept.drop(before)
        before = docs
    return docs
