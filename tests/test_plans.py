"""Physical plans are the intended ones: pruned scans, pushed filters, no nested loops, limits before sorts."""

from __future__ import annotations

import pytest

from catalog.spark_queries import QUERIES, orders, tolerant_orders
from twinframe import compare
from twinframe.operators.keys import key_profile

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_nested_loops_or_products(spark, no_broadcast):
    for name in ("overview_tolerant", "only_in_a", "diff_join_flat", "rows_diffs", "duplicate_pairs_hot_keys"):
        text = plan(QUERIES[name](spark, SF))
        assert "NestedLoop" not in text and "Cartesian" not in text, name


def test_statistics_scan_each_side_once_and_shuffle_on_the_key(spark, no_broadcast):
    text = plan(tolerant_orders(spark, SF).stats())
    assert text.count("FileScan") == 2
    assert text.count("Exchange hashpartitioning") == 2
    assert "SortMergeJoin" in text and "Inner" in text


def test_one_column_question_reads_only_what_it_needs(spark):
    text = plan(orders(spark, SF).stats().select("d0"))
    assert "o_custkey" in text and "o_orderpriority" not in text


def test_row_filter_reaches_the_scan(spark):
    text = plan(orders(spark, SF, where_clause="o_custkey = 7").stats())
    assert text.count("EqualTo(o_custkey,7)") == 2


def test_null_keys_are_dropped_before_the_join(spark, no_broadcast):
    text = plan(orders(spark, SF).stats())
    assert "PushedFilters: [IsNotNull(o_orderkey)]" in text


def test_page_is_a_top_k(spark):
    assert "TakeOrderedAndProject(limit=150" in plan(tolerant_orders(spark, SF).page("diffs", page=2).rows)


def test_only_the_hot_key_table_is_broadcast(spark, no_broadcast):
    a = spark.range(2000).selectExpr("id % 3 as k", "id as v")
    comparison = compare(a, a, pk_columns=["k"], hot_key_rows=100, on_duplicates="pairs")
    assert comparison._hot.table.count() == 3
    for df in (comparison.stats(), comparison.only_in("a"), comparison.rows("diffs")):
        text = plan(df)
        assert text.count("BroadcastExchange") == text.count("BroadcastHashJoin") > 0
        below = text.split("BroadcastExchange")[1:]
        assert all("hot-keys" in part.split("BroadcastHashJoin")[0] for part in below)


def test_bucketed_tables_are_compared_without_a_shuffle(spark, no_broadcast):
    source = spark.read.parquet(f"{SF}/orders.parquet")
    for name in ("bucketed_a", "bucketed_b"):
        source.write.bucketBy(4, "o_orderkey").sortBy("o_orderkey").mode("overwrite").saveAsTable(name)
    comparison = compare(spark.table("bucketed_a"), spark.table("bucketed_b"), pk_columns=["o_orderkey"])
    profile = key_profile(comparison.a, comparison.b, comparison.config)
    for df in (profile, comparison.stats(), comparison.only_in("a"), comparison.diff_join(), comparison.rows("diffs")):
        # Size classes are a few dozen rows.
        shuffles = [line for line in plan(df).splitlines() if "Exchange hashpartitioning" in line]
        assert all("hashpartitioning(size_class" in line for line in shuffles)


def test_tables_without_null_keys_are_not_searched_for_them(spark, no_broadcast):
    comparison = orders(spark, SF)
    assert plan(comparison.only_in("a")).count("FileScan") == 2
    assert plan(comparison.diff_join()).count("FileScan") == 2


def test_hot_pairs_are_split_into_many_cells(spark):
    a = spark.range(3000).selectExpr("1 as k", "id as v")
    b = spark.range(2000).selectExpr("1 as k", "id as v")
    comparison = compare(a, b, pk_columns=["k"], hot_key_rows=100, pair_budget=1e9, on_duplicates="pairs")
    row = comparison._hot.table.first()
    assert (row.parts_a, row.parts_b) == (30, 20)
    assert comparison.strategy == "pairs"
    assert comparison.rows("all").count() == 6_000_000
