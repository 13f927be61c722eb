"""Statistics of repeated keys, counted by key in one shuffle."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import overview_of, stats_of
from pyspark.sql import functions as F

from twinframe import Precision, Seconds, compare


def grouped(spark, size: int):
    rng = random.Random(8)
    start = datetime(2024, 1, 1)
    rows = lambda: [
        (rng.choice([None, *range(size // 4)]), rng.randrange(2), rng.choice([None, 0.0, -0.0, float("nan"), 1.25, 1.5]), rng.choice([None, start + timedelta(seconds=rng.randrange(9))]), rng.choice("xy"))
        for _ in range(size)
    ]
    schema = "k long, j int, n double, t timestamp_ntz, s string"
    return spark.createDataFrame(rows(), schema), spark.createDataFrame(rows(), schema)


def test_counting_by_key_shuffles_each_row_once(spark):
    """One exchange of the rows, by key, however many columns are compared; the other gathers a row of counts a task."""
    a, b = grouped(spark, 400)
    comparison = compare(a, b, pk_columns=["k", "j"], column_tolerances={"n": Precision(0), "t": Seconds(3)}, pair_budget=0.0)
    assert comparison.strategy == "groups"
    plan = comparison.stats()._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning") + initial.count("Exchange SinglePartition") == 2
    assert "Expand" not in plan and "Generate" not in plan


@pytest.mark.parametrize("hot", [100_000, 6])
def test_counting_by_key_agrees_with_pairs(spark, hot):
    a, b = grouped(spark, 400)
    a, b = (df.unionAll(df.limit(0).sparkSession.range(20).select(F.lit(1).cast("long"), F.lit(1), F.col("id").cast("double"), F.lit(None).cast("timestamp_ntz"), F.lit("x"))) for df in (a, b))
    settings = {"pk_columns": ["k", "j"], "column_tolerances": {"n": Precision(0), "t": Seconds(3)}}
    by_pairs = compare(a, b, pair_budget=1e9, **settings).run()
    by_key = compare(a, b, pair_budget=0.0, hot_key_rows=hot, **settings).run()
    assert (by_pairs.strategy, by_key.strategy, by_key._hot is None) == ("pairs", "groups" if hot == 100_000 else by_key.strategy, hot == 100_000)
    assert overview_of(by_key) == overview_of(by_pairs) and stats_of(by_key) == stats_of(by_pairs)
