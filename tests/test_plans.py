"""What the plans must not contain at any scale."""

import re

import pytest

from docloom import registry
from docloom.operators import dataset as D
from docloom.operators import extract as X
from docloom.operators import retrieval as R
from docloom.operators import tokens as K
from docloom.registry import files, tables

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def big_tables(spark):
    """No side is small enough to be broadcast by itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    big_tables(spark)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in files.QUERIES])
def test_no_cross_joins(spark, no_broadcast, name):
    plan = plan_of(registry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_extraction_shuffles_the_elements_once_by_segment(spark, no_broadcast):
    plan = plan_of(X.extract_items(tables.elements(spark, SF_DIR), "doc_id"))
    assert len(re.findall(r"Exchange hashpartitioning\(doc_id#\d+L, segment#\d+L", plan)) == 2
    assert "SinglePartition" not in plan and "Python" not in plan
    # no window gathers a document: all are by document and segment, or over segment summaries
    for spec in re.findall(r"windowspecdefinition\(doc_id#\d+L, (\w+)#", plan):
        assert spec in ("segment", "idx") or spec.startswith("segment")


def test_only_needed_columns_are_read(spark):
    plan = plan_of(X.extract_items(tables.elements(spark, SF_DIR), "doc_id"))
    assert set(re.findall(r"ReadSchema: (\S+)", plan)) == {"struct<doc_id:bigint,text:string>"}


def test_application_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "chunks")
    spark.range(10).selectExpr("id AS chunk_id", "CAST(id % 3 AS STRING) AS application").write.partitionBy(
        "application"
    ).parquet(path)
    plan = plan_of(R.filter_application(spark.read.parquet(path), "1"))
    assert re.search(r"PartitionFilters: \[[^\]]*application#\d+ = 1\)", plan)


def test_top_k_is_cut_before_the_shuffle(spark, no_broadcast):
    vec = spark.createDataFrame([(1, "a", [1.0, 0.0])], "query_id bigint, application string, embedding array<float>")
    plan = plan_of(R.knn_join(vec, vec.withColumnRenamed("query_id", "chunk_id"), 5))
    exchange = plan.index("Exchange hashpartitioning(query_id")
    assert plan.index("WindowGroupLimit", exchange) > exchange
    assert "BroadcastExchange" not in plan


def test_split_and_holdout_move_no_rows(spark, no_broadcast):
    rows = tables.documents(spark, SF_DIR).select("doc_id", "source", "text")
    for df in (D.train_test_split(rows, "doc_id"), D.holdout_groups(rows, "source")[0]):
        exchanged = [line for line in plan_of(df).splitlines() if "Exchange hash" in line]
        plan = plan_of(df)
        assert "SortMergeJoin" not in plan.split("BroadcastHashJoin")[0]
        assert all("text" not in line for line in exchanged)


def test_frequent_words_are_a_bounded_broadcast(spark, no_broadcast):
    lines = spark.createDataFrame([(1, "a b a")], "id bigint, input string")
    vocab = K.build_vocab(lines)
    plan = plan_of(K.encode_tokens(lines, vocab, ["id"]))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
