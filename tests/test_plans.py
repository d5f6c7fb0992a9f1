"""The plans themselves: what is scanned, shuffled and broadcast."""

import pytest
from compare import differences, duck

from catalog.oracle import oracle_sql
from catalog.queries import QUERIES, class_documents
from tidemark import sizes
from tidemark.operators import cohort, sampling, tfidf

FOLDER = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"mlp_predict"}))
def test_no_cross_product(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


LOOKUPS = ["cut_by_time", "cut_by_position", "cut_by_priority", "companion_first_match", "author_last_tokens", "sample_frac_per_group"]


@pytest.fixture
def stored_lookups(spark, monkeypatch, tmp_path):
    """Lookups as a job with a folder does them, without broadcasts from Spark's own estimates."""
    real = sizes.lookup_join
    for module in (cohort, sampling):
        monkeypatch.setattr(module, "lookup_join", lambda *a, **k: real(*a, **{**k, "folder": str(tmp_path)}))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", LOOKUPS)
def test_composing_a_plan_runs_nothing(spark, name):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"compose-{name}", "")
    plan_of(spark, name)
    spark.sparkContext.setJobGroup("", "")
    assert not tracker.getJobIdsForGroup(f"compose-{name}")


@pytest.mark.parametrize("name", LOOKUPS)
def test_stored_small_sides_are_broadcast(spark, stored_lookups, name):
    plan = plan_of(spark, name)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", LOOKUPS)
def test_large_sides_are_salted(spark, stored_lookups, monkeypatch, name):
    monkeypatch.setattr(sizes, "BROADCAST_ROWS", 0)
    plan = plan_of(spark, name)
    assert "SortMergeJoin" in plan and "_salt" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", LOOKUPS)
@pytest.mark.parametrize("rows", [0, 10**6])
def test_all_ways_of_joining_agree(spark, stored_lookups, monkeypatch, name, rows):
    monkeypatch.setattr(sizes, "BROADCAST_ROWS", rows)
    folder = "/root/testdata/sf0.01"
    assert differences(QUERIES[name](spark, folder), duck(folder), oracle_sql()[name]) == ""


def test_splits_of_large_files_are_kept(spark, tmp_path):
    """Three large files feed as many tasks as they have splits, without a shuffle of the texts."""
    for part in range(3):
        text = f"concat_ws(' ', transform(sequence(1, 20), i -> md5(concat(id, ' ', i, ' {part}')))) AS text"
        rows = spark.range(4000).selectExpr("id AS doc_id", text, "'en' AS lang", "'s' AS source", "0L AS n_chars")
        rows.coalesce(1).write.option("parquet.block.size", 262144).mode("append").parquet(str(tmp_path / "documents.parquet"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "524288")
    try:
        docs = QUERIES["tokens"](spark, str(tmp_path))
        assert docs.rdd.getNumPartitions() > 8 and "Exchange" not in docs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_cuts_need_no_window_over_an_author(spark):
    assert "Window" not in plan_of(spark, "cut_by_time")


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, "distinct_authors")
    assert "ReadSchema: struct<user_id:bigint>" in plan
    assert "PushedFilters: [IsNotNull(user_id), Not(EqualTo(user_id,7))]" in plan
    assert "PushedFilters: [GreaterThanOrEqual(ts," in plan_of(spark, "event_window").replace("IsNotNull(ts), ", "")


def test_heads_are_cut_before_the_shuffle(spark):
    for name in ("top_words", "top_words_all"):
        assert "WindowGroupLimit" in plan_of(spark, name)
    assert "TakeOrderedAndProject" not in plan_of(spark, "sample_n")


def test_totals_reuse_the_counts(spark):
    df = QUERIES["word_shares"](spark, FOLDER)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final


def test_texts_are_tokenised_once(spark):
    """The weights only read the stored tallies; the tallies hold one tokenising projection."""
    assert "split(" not in plan_of(spark, "tfidf_avg")
    tallies = tfidf.word_tallies(class_documents(spark, FOLDER), "doc_id")
    plan = tallies._jdf.queryExecution().executedPlan().toString()
    assert sum("split(" in line for line in plan.splitlines()) == 1 and "FileScan" in plan
