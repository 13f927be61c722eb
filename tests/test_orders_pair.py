"""The small orders pair with known answers."""

from __future__ import annotations

from datetime import date

import pytest
from conftest import overview_of, stats_of

from twinframe import CaseInsensitive, Precision, compare

SCHEMA = "id bigint, customer_name string, amount double, status string, created_at date"

A = [
    (1, "Alice Johnson", 150.1234, "completed"),
    (2, "Bob Smith", 275.5678, "completed"),
    (3, "Carol White", 89.9912, "pending"),
    (4, "Dave Brown", 432.0050, "completed"),
    (5, "Eve Davis", 67.2500, "cancelled"),
    (6, "Frank Miller", 199.9999, "completed"),
    (7, "Grace Lee", 315.7530, "pending"),
    (8, "Henry Wilson", 88.0010, "completed"),
    (9, "Iris Taylor", 245.5000, "completed"),
    (10, "Jack Anderson", 178.3042, "pending"),
]
B = [
    (1, "Alice Johnson", 150.1239, "completed"),
    (2, "Bob Smith", 275.5700, "completed"),
    (3, "Carol White", 89.9987, "shipped"),
    (4, "Dave Brown", 432.0050, "completed"),
    (5, "eve davis", 67.2501, "cancelled"),
    (6, "Frank Miller", 200.0001, "completed"),
    (7, "Grace Lee", 315.7530, "completed"),
    (9, "Iris Taylor", 245.5000, "completed"),
    (10, "Jack Anderson", 178.3100, "pending"),
    (11, "Karen Martinez", 520.0000, "pending"),
]


def _dated(rows):
    return [(*row, date(2024, 1, 14 + row[0])) for row in rows]


@pytest.fixture
def pair(spark):
    return spark.createDataFrame(_dated(A), SCHEMA), spark.createDataFrame(_dated(B), SCHEMA)


def test_overview(pair):
    found = overview_of(compare(*pair, pk_columns=["id"]))
    assert found == {
        "total_rows_a": 10,
        "total_rows_b": 10,
        "exclusive_a": 1,
        "exclusive_b": 1,
        "duplicate_pks_a": 0,
        "duplicate_pks_b": 0,
        "null_pks_a": 0,
        "null_pks_b": 0,
        "total_compared": 9,
        "rows_with_diffs": 7,
        "rows_minor": 0,
        "rows_identical": 2,
    }


def test_column_stats(pair):
    rows = {r["name"]: r for r in compare(*pair, pk_columns=["id"]).column_stats().collect()}
    assert {name: r.diff_count for name, r in rows.items()} == {
        "customer_name": 1,
        "amount": 6,
        "status": 2,
        "created_at": 0,
    }
    assert rows["amount"].match_count == 3
    assert rows["amount"].total == 9
    assert rows["amount"].match_pct == pytest.approx(100 * 3 / 9)
    assert rows["amount"].diff_pct == pytest.approx(100 * 6 / 9)
    assert rows["created_at"].match_pct == 100.0


def test_ranked_columns(pair):
    names = [r["name"] for r in compare(*pair, pk_columns=["id"]).ranked_columns().collect()]
    assert names == ["amount", "status", "customer_name", "created_at"]


def test_exclusive_rows(pair):
    comparison = compare(*pair, pk_columns=["id"])
    assert [r.customer_name for r in comparison.only_in("a").collect()] == ["Henry Wilson"]
    assert [r.customer_name for r in comparison.only_in("b").collect()] == ["Karen Martinez"]
    assert comparison.only_in("a").columns == pair[0].columns
    assert comparison.duplicate_keys("a").isEmpty()
    page = comparison.only_in_page("a")
    assert page.total == 1 and page.rows.count() == 1


def test_differing_rows(pair):
    rows = compare(*pair, pk_columns=["id"]).rows("diffs").collect()
    assert sorted(r.pk_id_a for r in rows) == [1, 2, 3, 5, 6, 7, 10]


def test_tolerances_turn_diffs_into_minor_ones(pair):
    comparison = compare(
        *pair,
        pk_columns=["id"],
        column_tolerances={"amount": Precision(2), "customer_name": CaseInsensitive()},
    )
    assert stats_of(comparison) == {"customer_name": (0, 1), "amount": (3, 3), "status": (2, 0), "created_at": (0, 0)}


def test_same_table_has_no_differences(pair):
    found = overview_of(compare(pair[0], pair[0], pk_columns=["id"]))
    assert found["rows_identical"] == 10 and found["exclusive_a"] == found["rows_with_diffs"] == 0


def test_swapping_sides_mirrors_the_overview(pair):
    one = overview_of(compare(*pair, pk_columns=["id"]))
    other = overview_of(compare(pair[1], pair[0], pk_columns=["id"]))

    def mirrored(name):
        return name[:-1] + {"a": "b", "b": "a"}[name[-1]] if name.endswith(("_a", "_b")) else name

    assert {mirrored(name): value for name, value in one.items()} == other
