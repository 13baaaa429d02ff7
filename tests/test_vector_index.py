"""The stored vector index: pruned searches, drains that touch few cells, versions that appear whole."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import vectors as vx
from tagloom.operators.vector_index import VectorIndex


def rows_of(spark, ids, seed=3, at=0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss((i % 12) * (d % 3 == i % 3), 1.0) for d in range(16)], at) for i in ids]
    return spark.createDataFrame(rows, "file_id long, vector array<float>, created_at long").cache()


def files_below(at):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(at) for f in fs if f.endswith(".parquet")}


def exact(v, seed, k):
    return vx.search(v.withColumn("genre_id", F.lit(0)), seed, k).collect()


def test_searches_read_probed_cells_only_and_find_most(spark, tmp_path):
    v = rows_of(spark, range(400))
    tags = spark.createDataFrame([(i, "genre", "even" if i % 2 == 0 else "odd", None) for i in range(400)], "file_id long, rel string, value_str string, value_num double")
    index = VectorIndex(spark, str(tmp_path))
    assert index.search([1.0] * 16, 3, 2).collect() == []
    assert index.build(v, tags) == 1 and index.about().lists == 26
    hit = 0
    for s in (1, 50, 200, 333):
        q = index.vector_of(s)
        hit += len({r.file_id for r in index.search(q, 10, 10, without=s).collect()} & {r.file_id for r in exact(v, s, 10)})
        assert index.search(q, 10, 26, without=s).collect() == exact(v, s, 10)
    assert hit >= 36
    q = index.vector_of(7)
    rows = index.probed(q, 3)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    filters = next(x for x in plan.split("\n") if "PartitionFilters" in x).split("PartitionFilters: [")[1]
    assert "cell" in filters.split("]")[0] and rows.select("cell").distinct().count() <= 3
    assert {r.file_id % 2 for r in index.search(q, 10, 26, genre="odd").collect()} == {1}
    assert index.search(q, 10, 26, genre="none").collect() == []
    assert all(r.score >= 0.5 for r in index.search(q, 50, 26, min_score=0.5).collect())


def test_drains_touch_few_cells_and_equal_a_fresh_index(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "a"))
    first = rows_of(spark, range(300))
    index.build(first)
    before = files_below(f"{index.root}/lists")
    new = rows_of(spark, [5, 300, 301], seed=9, at=1)
    assert index.drain(new) == 2
    after = files_below(f"{index.root}/lists")
    # what was there is the same; few cells were written
    assert before.items() <= after.items()
    assert 0 < len({f.split("cell=")[1].split("/")[0] for f in after.keys() - before.keys()}) <= 4
    more = rows_of(spark, [6, 302, 7], seed=10, at=2)
    index.drain(more)
    union = first.join(new.union(more).select("file_id"), "file_id", "left_anti").union(new).union(more).cache()
    fresh = VectorIndex(spark, str(tmp_path / "b"))
    fresh.build(union)
    assert index.about().docs == fresh.about().docs == 303 == index.rows().select("file_id").distinct().count()
    for s in (5, 7, 302):
        q = fresh.vector_of(s)
        assert q == index.vector_of(s)
        want = exact(union, s, 10)
        assert index.search(q, 10, 1000, without=s).collect() == fresh.search(q, 10, 1000, without=s).collect() == want
    # the same again, and nothing, change nothing that a search sees
    last = sorted(tuple(r) for r in index.rows().select("file_id", "vector", "created_at").collect())
    index.drain(more)
    assert sorted(tuple(r) for r in index.rows().select("file_id", "vector", "created_at").collect()) == last
    version = index.about().version
    assert index.drain(more.limit(0)) == index.promote(more.limit(0)) == version
    # an older version is still there until it is cleared away
    assert index.rows(1).count() == 300
    index.vacuum()
    assert sorted(tuple(r) for r in index.rows().select("file_id", "vector", "created_at").collect()) == last
    with pytest.raises(Exception):
        index.rows(1).count()


def test_promotion_fits_anew_when_cells_are_too_few(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path))
    index.promote(rows_of(spark, range(200)))
    assert (index.about().gen, index.about().lists) == (1, 13)
    index.promote(rows_of(spark, range(200, 300), at=1))
    assert (index.about().gen, index.about().lists) == (1, 13)
    index.promote(rows_of(spark, range(300, 700), at=2))
    assert (index.about().gen, index.about().lists, index.about().docs) == (2, 46, 700)
    index.vacuum()
    assert index.folder.names("lists") == index.folder.names("centers") == ["gen=2"] and index.rows().count() == 700


def test_what_fails_before_it_is_published_changes_nothing(spark, tmp_path, monkeypatch):
    index = VectorIndex(spark, str(tmp_path))
    v = rows_of(spark, range(100))
    index.build(v)
    want = sorted(r.file_id for r in index.rows().collect())
    with monkeypatch.context() as m:
        m.setattr(index.versions, "publish", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            index.drain(rows_of(spark, [100, 101], at=1))
    assert sorted(r.file_id for r in index.rows().collect()) == want and index.versions.latest() == 1
    index.drain(rows_of(spark, [100], at=1))
    assert sorted(r.file_id for r in index.rows().collect()) == [*want, 100]
    with pytest.raises(FileExistsError):
        index.versions.publish(2, cells=spark.range(1))


def test_empty_and_odd_rows(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path))
    schema = "file_id long, vector array<float>, created_at long"
    none = spark.createDataFrame([], schema)
    index.build(none)
    assert index.search([1.0, 0.0], 5, 5).collect() == [] and index.about().docs == 0
    odd = [(1, [0.0, 0.0], 0), (2, None, 0), (None, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (3, [0.0, 1.0], 5), (4, [1.0, 0.0], 0), (5, [1.0, 0.0], 0)]
    index.drain(spark.createDataFrame(odd, schema))
    assert [tuple(r) for r in index.search([1.0, 0.0], 9, 50).collect()] == [(4, 1.0), (5, 1.0), (1, 0.0), (3, 0.0)]
