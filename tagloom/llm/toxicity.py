"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its
words and their stems (hashed to 2^BITS weights); a document's is the noisy-or of its
sentences': toxic unless no sentence is. Weights are trained from labels of
documents alone, by gradient descent on the likelihood of the noisy-or, and
sentences' probabilities then say which ones offend.

The model is fitted on a bounded sample of labelled rows: of the MAX_TRAIN
documents with the smallest hashes of doc_id those of at most MAX_FEATURES
features (a word has up to three: itself and two stems), so that the sample's
size has a bound in bytes as well. Scores are of whole texts, of all rows.

Cases: a null or empty text has no sentences and score 0; of several labels of
a document the largest counts, null ones do not; without labels of both kinds
the weights are 0, and each score follows from the prior alone; repeated rows
come out repeated, and of several texts of one doc_id the smallest is trained on; rows without doc_id are scored, and not held out; an empty
table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Kept, fresh, lean, sliced

BITS = 18
MAX_TRAIN = 3_000
MAX_FEATURES = 12_000
STEPS = 150
MIN_DOCS = 3
PENALTY = 3e-5
TELLING = 3.0
#: Lengths of the beginnings that count as stems.
STEMS = (4, 5)
STRIP = "\"'`.,;:!?()[]{}<>*_~#|-"


def features_of(word: str) -> list[int]:
    """A word's features: itself and its beginnings, by which forms of a stem are alike; -1 for none."""
    if not word:
        return [-1] * (1 + len(STEMS))
    mask = (1 << BITS) - 1
    stems = [xxhash.xxh3_64_intdigest(f"{n} {word[:n]}") & mask if len(word) > n else -1 for n in STEMS]
    return [xxhash.xxh3_64_intdigest(word) & mask, *stems]


def sentences_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Each word's number among the different ones, those's features, each sentence's number of words, each text's number of sentences, and the sentences."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")), r"[.!?\n]+")
    flat, ends = lists.flatten(), np.asarray(lists.offsets)
    split = pc.ascii_split_whitespace(flat)
    words, word_ends = split.flatten(), np.asarray(split.offsets)
    coded = words.dictionary_encode()
    names = [w.strip(STRIP) for w in coded.dictionary.to_pylist()]
    features = np.array([features_of(w) for w in names], np.int64).reshape(len(names), 1 + len(STEMS))
    each = np.asarray(coded.indices).astype(np.int64)
    real = features[each, 0] >= 0
    before = np.concatenate([[0], np.cumsum(real)])
    per_sentence = np.diff(before[word_ends - word_ends[0]])
    filled = per_sentence > 0
    count = np.concatenate([[0], np.cumsum(filled)])
    return each[real], features, per_sentence[filled], np.diff(count[ends - ends[0]]), flat.filter(pa.array(filled))


def bags_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words' features, each sentence's number of them, and each text's number of sentences."""
    words, features, per_sentence, per_doc, _ = sentences_of(texts)
    each = features[words]
    have = (each >= 0).sum(axis=1)
    return each[each >= 0], _sums(have.astype(float), per_sentence).astype(np.int64), per_doc


def _sums(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; runs may be empty."""
    total = np.concatenate([[0.0], np.cumsum(x)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def train(words: np.ndarray, per_sentence: np.ndarray, per_doc: np.ndarray, y: np.ndarray, min_docs: int = MIN_DOCS, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and bias that make the noisy-or of sentences' probabilities likely.

    Features of fewer than `min_docs` documents get no weight, so that no
    document is learnt by heart, nor do those that are not in more toxic ones
    than chance would have (by TELLING standard deviations): the instances that
    make a bag positive carry them. A penalty holds weights down.
    """
    w, b = np.zeros(1 << BITS), -4.0
    if not (0 < y.sum() < len(y)):
        return w, b
    sentence = np.repeat(np.arange(len(per_sentence), dtype=np.int32), per_sentence)
    doc = np.repeat(np.arange(len(per_doc), dtype=np.int32), per_doc)
    # in how many documents, and toxic ones, each feature is: a document at a time, so that the driver holds no copies of all words
    n_held, n_toxic = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    ends = np.cumsum(_sums(per_sentence.astype(float), per_doc).astype(np.int64))
    for d, (start, end) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        held = np.unique(words[start:end])
        n_held[held] += 1
        n_toxic[held] += y[d] == 1
    share = y.mean()
    telling = (n_toxic - n_held * share) >= TELLING * np.sqrt(n_held * share * (1 - share) + 1e-9)
    seen = ((n_held >= min_docs) & telling)[words]
    words, sentence = words[seen], sentence[seen]
    used, at = np.unique(words, return_inverse=True)
    v, m, s2 = np.zeros(len(used)), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    n = float(len(y))
    for step in range(1, STEPS + 1):
        z = b + np.bincount(sentence, weights=v[at], minlength=len(per_sentence))
        total = np.bincount(doc, weights=np.logaddexp(0.0, z), minlength=len(per_doc))
        p = 1.0 / (1.0 + np.exp(-z))
        outer = np.where(y == 1, -1.0 / np.expm1(np.clip(total, 1e-6, 500.0)), 1.0)
        g = outer[doc] * p
        grad = np.append(np.bincount(at, weights=g[sentence], minlength=len(used)) / n + penalty * v, g.sum() / n)
        m, s2 = 0.9 * m + 0.1 * grad, 0.99 * s2 + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.99**step)) + 1e-6)
        v, b = v - move[:-1], b - move[-1]
    w[used] = v
    return w, float(b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        words, per_sentence, per_doc = bags_of(batch.column("text"))
        n_words = _sums(per_sentence.astype(float), per_doc).astype(np.int64)
        cut = lambda v, n, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(v.astype(kind)))
        yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), cut(words, n_words, np.int32), cut(per_sentence, per_doc, np.int32)], names=["doc_id", "toxic", "words", "per_sentence"])


BAGS = "doc_id long, toxic int, words array<int>, per_sentence array<int>"


def _useful(bags: DataFrame) -> np.ndarray:
    """The features that `train` will give a weight: what it counts, counted by Spark, so that no others travel to the driver."""
    n, toxic = bags.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    if not 0 < toxic < n:
        return np.zeros(0, np.int32)
    share = toxic / n
    each = bags.select((F.col("toxic") == 1).alias("is_toxic"), F.explode(F.array_distinct("words")).alias("feature"))
    counts = each.groupBy("feature").agg(F.count("*").cast("double").alias("held"), F.count_if("is_toxic").alias("toxic"))
    telling = F.col("toxic") - F.col("held") * share >= F.lit(TELLING) * F.sqrt(F.col("held") * share * (1 - share) + 1e-9)
    return np.array(sorted(r.feature for r in counts.where((F.col("held") >= MIN_DOCS) & telling).select("feature").collect()), np.int32)


def _only(useful: np.ndarray):
    """Bags with these features alone; all their sentences stay, empty ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, per_sentence = (batch.column(c) for c in ("words", "per_sentence"))
            flat, counts, per_doc = words.flatten().to_numpy(), per_sentence.flatten().to_numpy(), np.diff(np.asarray(per_sentence.offsets))
            keep = np.isin(flat, useful)
            sentence = np.repeat(np.arange(len(counts)), counts)
            left = np.bincount(sentence[keep], minlength=len(counts)).astype(np.int32)
            per_words = _sums(left.astype(float), per_doc).astype(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(v)) for v, n in ((flat[keep].astype(np.int32), per_words), (left, per_doc))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), *lists], names=["doc_id", "toxic", "words", "per_sentence"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """Trained on at most `max_train` labelled documents that are not held out."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # the sample is chosen among the labels, so that few texts move
    sample = one.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"), F.min("text").alias("text"))
    kept = Kept(docs.sparkSession)
    bags = kept.write(texts.mapInArrow(lean(_bags), BAGS).where(F.size("words") <= MAX_FEATURES))
    useful = _useful(bags)
    t = bags.mapInArrow(_only(useful), BAGS).toArrow().sort_by("doc_id").combine_chunks()
    kept.drop(bags)
    if not t.num_rows:
        return np.zeros(1 << BITS), -4.0
    words, per_sentence = (t[c].chunk(0) for c in ("words", "per_sentence"))
    fitted = train(words.flatten().to_numpy(), per_sentence.flatten().to_numpy(), np.diff(np.asarray(per_sentence.offsets)), t["toxic"].to_numpy())
    # what Arrow keeps for later goes back: the driver goes on to other stages
    del t, words, per_sentence
    pa.default_memory_pool().release_unused()
    return fitted


def _scorer(w: np.ndarray, b: float):
    w = w.astype(np.float32)
    used = np.flatnonzero(w)
    packed = (used.astype(np.int32), w[used])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(1 << BITS)
        full[packed[0]] = packed[1]
        for batch in sliced(batches):
            words, features, per_sentence, per_doc, sentences = sentences_of(batch.column("text"))
            each = np.where(features >= 0, full[features], 0.0).sum(axis=1)
            z = b + np.bincount(np.repeat(np.arange(len(per_sentence)), per_sentence), weights=each[words], minlength=len(per_sentence))
            owner = np.repeat(np.arange(len(per_doc)), per_doc)
            total = np.bincount(owner, weights=np.logaddexp(0.0, z), minlength=len(per_doc))
            score = np.clip(-np.expm1(-total), 0.0, 1.0)
            # the sentences that offend, by their own probability, the worst first
            p = 1.0 / (1.0 + np.exp(-z))
            hit = np.flatnonzero(p >= 0.5)
            first = np.cumsum(per_doc) - per_doc
            order = hit[np.lexsort((hit, -p[hit], owner[hit]))]
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[order], minlength=len(per_doc)))]).astype(np.int32)
            found = pa.StructArray.from_arrays([pa.array((order - first[owner[order]]).astype(np.int32)), pa.array(np.round(p[order], 6)), sentences.take(pa.array(order))], ["sentence", "score", "text"])
            rest = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.record_batch([*rest, pa.array(score), pa.array(per_doc.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), found)], names=[*[c for c in batch.schema.names if c != "text"], "score", "n_sentences", "offending"])

    return run


SCORED = "score double, n_sentences int, offending array<struct<sentence:int,score:double,text:string>>"


def score_documents(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences and offending (place among the sentences, probability, sentence in lower case)."""
    w, b = fit(docs, labels, max_train)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    scored = texts.mapInArrow(_scorer(w, b), f"doc_id {kind}, {SCORED}")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "offending")


def without_toxic(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of `docs` whose score is below 0.5, in one pass: rows travel through the scorer whole."""
    w, b = fit(docs, labels, max_train)
    name = fresh(docs, "scored_text")
    with_text = docs.select("*", F.col("text").cast("string").alias(name))
    run, columns = _scorer(w, b), docs.columns

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = pa.record_batch([batch.column(name)], names=["text"])
            # the scorer slices too; its parts come in order
            score = np.concatenate([x.column("score").to_numpy() for x in run([texts])])
            yield batch.filter(pa.array(score < 0.5)).select(columns)

    return with_text.mapInArrow(lean(filtered), docs.schema)
