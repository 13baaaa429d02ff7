"""The library's tables as views of the standard tables. Spark and DuckDB take the same text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]
VIEWS = {
    "files": """
SELECT p_partkey AS file_id, p_partkey % 5 AS library_id, concat(p_type, '/', p_brand, '/', p_partkey, '.flac') AS normalized_path, p_brand AS artist, p_type AS album, p_name AS title, p_size * 10.0e0 AS duration_seconds, CAST(floor(p_retailprice * 100) AS BIGINT) AS file_size
FROM part""",
    "mood_edges": """
SELECT DISTINCT l_partkey AS file_id, CASE WHEN l_discount >= 0.095e0 THEN 'nom:mood-strict' WHEN l_discount >= 0.085e0 THEN 'nom:mood-regular' ELSE 'nom:mood-loose' END AS rel, o_orderpriority AS value_str
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_discount >= 0.075e0 AND l_tax >= 0.065e0""",
    "tags_long": """
SELECT file_id, 'artist' AS rel, artist AS value_str, CAST(NULL AS DOUBLE) AS value_num FROM files
UNION ALL SELECT file_id, 'album', album, CAST(NULL AS DOUBLE) FROM files
UNION ALL SELECT file_id, 'genre', split_part(title, ' ', 1), CAST(NULL AS DOUBLE) FROM files
UNION ALL SELECT file_id, 'genre', split_part(title, ' ', 2), CAST(NULL AS DOUBLE) FROM files
UNION ALL SELECT file_id, rel, NULL, CASE rel WHEN 'year' THEN CAST(y AS DOUBLE) WHEN 'nom:energy' THEN e / 50.0e0 ELSE c / 10000.0e0 END
FROM (SELECT l_partkey AS file_id, min(year(l_shipdate)) AS y, max(l_quantity) AS e, min(l_extendedprice) AS c FROM lineitem GROUP BY l_partkey) CROSS JOIN (VALUES ('year'), ('nom:energy'), ('nom:calm')) AS r(rel)
UNION ALL SELECT file_id, rel, value_str, CAST(NULL AS DOUBLE) FROM mood_edges""",
    "plays": """
SELECT o_custkey AS user_id, l_partkey AS nd_id, count(*) AS playcount, max(o_orderdate) AS last_played
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey""",
    "vectors": "SELECT vec_id AS file_id, embedding AS vector, label AS genre_id FROM embeddings",
    "tiers": """
SELECT vec_id AS file_id, embedding AS vector, 'cold' AS tier, CAST(vec_id AS BIGINT) AS created_at FROM embeddings WHERE label % 3 <> 0
UNION ALL SELECT vec_id, embedding, 'hot', CAST(vec_id AS BIGINT) + 1000 FROM embeddings WHERE label % 3 <> 1""",
    "segments": "SELECT l_partkey AS file_id, l_orderkey * 10 + l_linenumber AS segment_id, l_discount * 10 AS score_a, l_tax * 12.5e0 AS score_b FROM lineitem",
    "libraries": """
SELECT r_regionkey AS library_id, lower(r_name) AS name, CASE WHEN r_regionkey = 0 THEN 'music' ELSE concat('music/', lower(r_name)) END AS root_path,
  r_regionkey <> 3 AS is_enabled, CASE WHEN r_regionkey = 1 THEN 'off' WHEN r_regionkey = 2 THEN 'poll' WHEN r_regionkey = 4 THEN NULL ELSE 'event' END AS watch_mode,
  CASE WHEN r_regionkey % 2 = 1 THEN 'none' WHEN r_regionkey = 2 THEN 'minimal' ELSE 'full' END AS file_write_mode
FROM region""",
    "library_scans": """
SELECT o_orderkey AS scan_id, o_custkey % 4 AS library_id, CASE WHEN o_orderstatus = 'O' THEN 'running' ELSE 'completed' END AS status, CAST(floor(o_totalprice) AS BIGINT) AS files_processed, o_orderdate AS started_at
FROM orders""",
    "states": """
SELECT f.file_id, a.axis, (f.file_id * a.k + CAST(floor(f.file_id / 5.0e0) AS BIGINT)) % 7 < 4 AS positive
FROM files f CROSS JOIN (VALUES ('tagged', 2), ('too_short', 3), ('calibrated', 6), ('tags_written', 7), ('tags_current', 8), ('scanned', 11), ('vectors_extracted', 12), ('errored', 13)) AS a(axis, k)""",
    "claims": "SELECT DISTINCT l_partkey AS file_id, l_suppkey AS worker_id FROM lineitem WHERE l_quantity >= 49",
    "nd_links": "SELECT concat('nd', CAST(p_partkey AS VARCHAR(20))) AS nd_id, p_partkey AS file_id FROM part WHERE p_size < 45",
    "snapshots": """
SELECT concat('head', CAST(o_custkey % 12 AS VARCHAR(20))) AS calibration_key, o_orderkey AS snapshot_at, o_totalprice / 1000000.0e0 AS p5, o_totalprice / 500000.0e0 AS p95, o_custkey AS n
FROM orders""",
}
NEEDS = {"tags_long": ["files", "mood_edges"], "states": ["files"]}

#: Bytes of Parquet that a shuffle cuts a partition for; small ones are put together again when they have been written.
PER_PARTITION = 4 << 20
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def cut_finely(spark: SparkSession, paths: list[str]) -> None:
    """Lets shuffles be cut into as many partitions as the tables of a query ask for, so that a task's share does not grow with them.

    With the same number of partitions for any input, what one task sorts or
    aggregates is a fixed share of it. The number is never lowered, and adaptive
    execution coalesces what came out small.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    size = sum(p.getFileSystem(conf).getContentSummary(p).getLength() for p in map(fs_path, paths))
    now = int(spark.conf.get(INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if size // PER_PARTITION > now:
        spark.conf.set(INITIAL, str(size // PER_PARTITION))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views, as a DataFrame over the Parquet tables; only those it reads are opened."""
    text = VIEWS[name]
    for other in NEEDS.get(name, []):
        view(spark, sf_dir, other).createOrReplaceTempView(other)
    paths = {t: f"{sf_dir}/{t}.parquet" for t in TABLES if re.search(rf"\b{t}\b", text)}
    for t, path in paths.items():
        spark.read.parquet(path).createOrReplaceTempView(t)
    cut_finely(spark, list(paths.values()))
    return spark.sql(text)


def with_views(*names: str) -> str:
    """The WITH clause that gives an oracle the same views."""
    order: list[str] = []
    for n in names:
        for x in (*NEEDS.get(n, []), n):
            if x not in order:
                order.append(x)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
