from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("twinframe-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Build a DataFrame from rows and a DDL schema."""

    def build(schema: str, *rows: tuple):
        return spark.createDataFrame(list(rows), schema)

    return build


def stats_of(comparison) -> dict[str, tuple[int, int]]:
    """(diff_count, minor_count) by column."""
    return {r["name"]: (r.diff_count, r.minor_count) for r in comparison.column_stats().collect()}


def overview_of(comparison) -> dict[str, int]:
    return comparison.overview().first().asDict()
