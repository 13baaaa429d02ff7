"""How far the sources of a language differ in their words: shards of words are counted and compared by DuckDB, Spark merges.

Documents' words are counted in the tasks that read them. The counts are dealt
into shards by language and word, so that all that is known of a word is in one
shard; DuckDB sums them up there, leaves out rare words, and the counts that
stay are written. Spark adds up the sizes of groups and languages, which each
shard needs for the shares p and q. Then each shard's DuckDB compares the
sources of each of its words: sums over pairs of sources, and its best words of
each group. Spark adds the sums and ranks.

A pair's value sums f over all kept words of the language. Most groups lack most
words, whose share is then the same base b, so that only words that both groups
have need to be met:

    sum f(p, q) = sum over words of both: f(p, q) - f(p, b') - f(b, q) + f(b, b')
                + sum over words of the first: f(p, b') - f(b, b')
                + sum over words of the second: f(b, q) - f(b, b')
                + V * f(b, b')

The second and third sums depend on a word's count only and are taken over each
group's histogram of counts. All of it is in integers and exact. Every part of
the work is in proportion to the counts, to what words share (as the shards
spread it) or to the pairs of sources, which the result lists anyway.

Cases: null text, lang or source is ''; a text without words still makes its
group occur; equal values rank by item; repeated rows count as often as they
occur; a language without kept words has pairs of value 0 and no words; a lone
source has no pairs; an empty table gives no rows; further columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, sliced, text_of

MIN_DOCS, TOP = 10, 10
#: Rows that a task gathers before it adds up equal ones, and what DuckDB may hold before it spills.
GATHERED, MEMORY = 400_000, "256MB"

#: Each byte as it is read: A-Z in lower case, all that is no letter and below 128 a space.
READ_AS = np.array([b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and each text's number of them."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    plain = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(READ_AS[data])])
    lists = pc.ascii_split_whitespace(plain)
    flat, ends = lists.flatten(), np.asarray(lists.offsets)
    real = pc.not_equal(flat, "")
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real), np.diff(before[ends - ends[0]])


def _counts(batch: pa.RecordBatch) -> pa.Table:
    """lang, source, term, how often and in how many of these documents."""
    words, per_doc = _terms(batch.column("text"))
    coded = words.dictionary_encode()
    vocabulary, code = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
    groups = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
    ids: dict[tuple, int] = {}
    group = np.fromiter((ids.setdefault((g["lang"], g["source"]), len(ids)) for g in groups.to_pylist()), np.int64, len(groups))
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    # one sort by document and word; groups are summed from what it leaves
    each, n = np.unique(doc * max(len(vocabulary), 1) + code, return_counts=True)
    key, where = np.unique(group[each // max(len(vocabulary), 1)] * max(len(vocabulary), 1) + each % max(len(vocabulary), 1), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, where, n)
    names = list(ids)
    g, term = key // max(len(vocabulary), 1), key % max(len(vocabulary), 1)
    columns = [pa.array([x[i] for x in names], pa.string()).take(pa.array(g)) for i in (0, 1)]
    return pa.table({"lang": columns[0], "source": columns[1], "term": vocabulary.take(pa.array(term)).cast(pa.string()), "n": total, "df": np.bincount(where, minlength=len(key)).astype(np.int64)})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of what a task reads; equal rows are added up as long as they are few enough."""
    rest: list[pa.Table] = []
    size = 0
    for batch in sliced(batches, 4 << 20):
        rest.append(_counts(batch))
        size += rest[-1].num_rows
        if size > GATHERED:
            added = _added(rest)
            rest, size = [added], added.num_rows
            if size > GATHERED // 2:
                yield from added.to_batches(50_000)
                rest, size = [], 0
    if rest:
        yield from _added(rest).to_batches(50_000)


def _added(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("df", "sum")])
    return t.select(["lang", "source", "term", "n_sum", "df_sum"]).rename_columns(["lang", "source", "term", "n", "df"])


def _in_shard(sql: str, columns: list[str]):
    """Runs SQL over a shard's rows, which DuckDB takes in a batch at a time and spills if it has to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tempfile

        import duckdb

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill, "preserve_insertion_order": False}) as con:
            batch = pa.Table.from_batches([first])
            con.execute("CREATE TABLE shard AS SELECT * FROM batch")
            for more in batches:
                batch = pa.Table.from_batches([more])
                con.execute("INSERT INTO shard SELECT * FROM batch")
            reader = con.sql(sql).to_arrow_reader(50_000)
            for out in reader:
                if out.num_rows:
                    yield pa.record_batch([out.column(c) for c in columns], names=columns)

    return run


#: The kept words' counts, the language's total of each, and one mark a word by which words are counted.
KEPT_SQL = """
WITH c AS (SELECT lang, source, term, sum(n) AS n, sum(df) AS df FROM shard GROUP BY ALL)
SELECT lang, source, term, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER w AS BIGINT) AS total,
  CAST(row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS INTEGER) AS one
FROM c WINDOW w AS (PARTITION BY lang, term) QUALIFY sum(df) OVER w >= {min_docs}
"""

#: f(p, q); shares are below 2^30, so that squares fit 64 bits.
F_SQL = "(({0} - {1}) * ({0} - {1})) // ({0} + {1})"
COMPARED_SQL = """
SELECT 'pair' AS part, a.lang AS lang, a.source AS source, b.source AS item, CAST(sum({pp} - {pb} - {bp} + {bb}) AS BIGINT) AS value
FROM shard a JOIN shard b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY a.lang, a.source, b.source
UNION ALL
SELECT 'term', lang, source, term, value FROM (
  SELECT lang, source, term, {pq} AS value FROM shard WHERE p > q
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {top})
"""


def share(count: str, n: str, v: str) -> Column:
    """p = 1 + floor(10^9 * (count + 2) / (n + 2 * v)), exact for any counts; 0 without kept words."""
    wide = lambda c: f"CAST({c} AS DECIMAL(28,0))"
    return F.expr(f"CASE WHEN {v} > 0 THEN 1 + (CAST(1000000000 AS DECIMAL(10,0)) * ({wide(count)} + 2)) DIV ({wide(n)} + 2 * {wide(v)}) ELSE 0L END")


def differ(p: str, q: str) -> Column:
    return F.expr(f"CASE WHEN {p} + {q} > 0 THEN (({p} - {q}) * ({p} - {q})) DIV ({p} + {q}) ELSE 0L END")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank, from `docs` (text, lang, source)."""
    kept = Kept(docs.sparkSession)
    docs = docs.select(*(text_of(c).alias(c) for c in ("text", "lang", "source")))
    counted = docs.mapInArrow(_count, "lang string, source string, term string, n long, df long")
    shards = counted.repartition("lang", "term").mapInArrow(_in_shard(KEPT_SQL.format(min_docs=min_docs), ["lang", "source", "term", "n", "total", "one"]), "lang string, source string, term string, n long, total long, one int")
    counts = kept.write(shards)

    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.sum("one").alias("ones"))
    of_lang = sizes.groupBy("lang").agg(F.sum("group_n").alias("lang_n"), F.sum("ones").alias("kept"))
    groups = docs.select("lang", "source").distinct().join(sizes.drop("ones"), ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    groups = kept.write(groups.withColumn("b", share("0", "group_n", "kept")))

    shares = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", share("n", "group_n", "kept").alias("p"), share("total", "lang_n", "kept").alias("q"), "b")
    f = lambda a, b: F_SQL.format(a, b)
    sql = COMPARED_SQL.format(pp=f("a.p", "b.p"), pb=f("a.p", "b.b"), bp=f("a.b", "b.p"), bb=f("a.b", "b.b"), pq=f("p", "q"), top=top)
    compared = kept.write(shares.repartition("lang", "term").mapInArrow(_in_shard(sql, ["part", "lang", "source", "item", "value"]), "part string, lang string, source string, item string, value long"))

    # what words of one group alone add, by the histogram of its counts, and what words of neither do
    hist = counts.groupBy("lang", "source", "n").agg(F.count("*").alias("m")).join(groups, ["lang", "source"]).select("lang", "source", "m", share("n", "group_n", "kept").alias("p"), "b")
    other = groups.select("lang", F.col("source").alias("item"), F.col("b").alias("bo"), F.col("kept"))
    exact = lambda c: c.cast("decimal(38,0)").alias("value")
    alone = hist.join(other.drop("kept"), "lang").where("source <> item").select("lang", "source", "item", exact(F.col("m") * (differ("p", "bo") - differ("b", "bo"))))
    alone = alone.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = compared.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    neither = groups.select("lang", "source", "b").join(other, "lang").where("source <> item").select("lang", "source", "item", exact(F.col("kept") * differ("b", "bo")))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = neither.unionByName(alone).unionByName(turned(alone)).unionByName(both).unionByName(turned(both))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value")).withColumn("part", F.lit("pair"))

    # ranks of words are bounded, so that each task passes on as many as can still count
    nth = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = compared.where("part = 'term'").withColumn("rank", nth).where(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", nth).unionByName(terms)
    return ranked.select("lang", "source", "part", "item", "value", "rank")
