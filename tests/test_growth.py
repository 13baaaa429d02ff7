"""Plans that hold on large tables: what grows with the input is neither broadcast nor left to too few tasks."""

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def eager(spark):
    """A session that broadcasts whatever it is free to, as it does where compressed columns look small."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_moves_broadcast_no_table(eager):
    assert "BroadcastHashJoin" not in plan_of(entry.queries()["file_moves"](eager, SMALL))


@pytest.mark.parametrize("name", ["files_path_prefix", "files_in_folders", "files_with_tags"])
def test_paths_and_tags_are_not_broadcast(eager, name):
    plan = plan_of(entry.queries()[name](eager, SMALL))
    # tags have a table of three constants, and in this view orders
    assert "normalized_path" not in "".join(line for line in plan.splitlines() if "BroadcastHashJoin" in line)
    assert "SortMergeJoin" in plan


def test_simhash_broadcasts_no_fingerprints(eager, monkeypatch):
    from tagloom.llm import common, simhash

    plans, write = [], common.Kept.write
    noted = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(common.Kept, "write", lambda self, df: (noted(df), write(self, df))[1])
    docs = eager.createDataFrame([(i, f"one two three four five six seven eight {i // 2}") for i in range(40)], "doc_id long, text string")
    out = simhash.near_components(docs)
    noted(out)
    assert out.where("component_id <= doc_id").count() == 40
    assert len(plans) > 5 and not any("BroadcastHashJoin" in p for p in plans)


def test_lists_are_fitted_by_several_tasks(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    seen, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, df: (seen.append((df.rdd.getNumPartitions(), self.getInitMode())), fit(self, df))[1])
    rows = entry.queries()["vector_ivf_stored"](spark, SMALL).collect()
    assert len(rows) == 10
    assert seen and all(n > 1 and mode == "random" for n, mode in seen)


def test_taste_travels_before_it_is_taken_apart(spark):
    plan = plan_of(entry.queries()["taste_centroid"](spark, SMALL)).split("== Initial Plan ==")[0]
    # the plan's root comes first: no exchange above the rows of dimensions
    assert "Exchange" not in plan[: plan.index("Generate posexplode")]


def test_shuffles_are_cut_by_the_size_of_the_tables(spark, monkeypatch):
    from tagloom.sources import views

    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    monkeypatch.setattr(views, "PER_PARTITION", 4096, raising=False)
    try:
        df = entry.queries()["head_decisions"](spark, SMALL)
        cut = int(spark.conf.get(initial, None) or 0)
        assert cut > 4 and df.count() > 0
        monkeypatch.setattr(views, "PER_PARTITION", 1 << 30)
        entry.queries()["head_decisions"](spark, SMALL)
        assert int(spark.conf.get(initial)) == cut
    finally:
        spark.conf.unset(initial)
