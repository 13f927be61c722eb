from __future__ import annotations

import pytest
from conftest import overview_of, stats_of

from twinframe import DiffConfig, compare

LINES = "order_id int, line_id int, name string, amount double"
PEOPLE = "first_name string, last_name string, amount double"


def test_composite_key(frame):
    a = frame(LINES, (1, 1, "x", 1.0), (1, 2, "y", 2.0), (2, 1, "z", 3.0))
    b = frame(LINES, (1, 1, "x", 1.0), (1, 2, "y", 2.5), (3, 1, "w", 4.0))
    comparison = compare(a, b, pk_columns=["order_id", "line_id"])
    found = overview_of(comparison)
    assert (found["exclusive_a"], found["exclusive_b"], found["total_compared"]) == (1, 1, 2)
    assert found["rows_with_diffs"] == 1
    assert comparison.diff_join().columns[:4] == [
        "pk_order_id_a", "pk_order_id_b", "pk_line_id_a", "pk_line_id_b",
    ]


def test_three_part_key(frame):
    schema = "order_id int, line_id int, region string, amount double"
    a, b = frame(schema, (1, 1, "n", 1.0), (1, 1, "s", 2.0)), frame(schema, (1, 1, "n", 1.0), (1, 1, "s", 9.0))
    found = overview_of(compare(a, b, pk_columns=["order_id", "line_id", "region"]))
    assert (found["total_compared"], found["rows_with_diffs"]) == (2, 1)


def test_composite_duplicates(frame):
    schema = "order_id int, line_id int, name string"
    a, b = frame(schema, (1, 1, "x"), (1, 1, "y"), (2, 1, "z")), frame(schema, (1, 1, "x"), (2, 1, "z"))
    comparison = compare(a, b, pk_columns=["order_id", "line_id"])
    found = overview_of(comparison)
    assert (found["duplicate_pks_a"], found["duplicate_pks_b"]) == (1, 0)
    assert found["total_compared"] == 3
    assert [tuple(r) for r in comparison.duplicate_keys("a").collect()] == [(1, 1, 2)]
    page = comparison.duplicate_keys_page("a")
    assert page.total == 1 and page.columns == ["order_id", "line_id", "count"]


def test_composite_key_with_nulls(frame):
    schema = "order_id int, line_id int, name string"
    a, b = frame(schema, (1, None, "x"), (None, 1, "y"), (1, 1, "z")), frame(schema, (1, 1, "z"))
    found = overview_of(compare(a, b, pk_columns=["order_id", "line_id"]))
    assert (found["null_pks_a"], found["null_pks_b"]) == (2, 0)
    assert (found["exclusive_a"], found["total_compared"]) == (2, 1)


def test_null_is_a_group_among_duplicates(frame):
    schema = "id int, v int"
    a, b = frame(schema, (None, 1), (None, 2), (1, 1)), frame(schema, (None, 1), (1, 1))
    comparison = compare(a, b, pk_columns=["id"])
    found = overview_of(comparison)
    assert (found["duplicate_pks_a"], found["null_pks_a"], found["total_compared"]) == (1, 2, 1)
    assert [tuple(r) for r in comparison.duplicate_keys("a").collect()] == [(None, 2)]
    assert comparison.only_in("a").count() == 2 and comparison.only_in("b").count() == 1
    assert comparison.diff_join().count() == 4


@pytest.mark.parametrize("text", ["CONCAT(first_name, '_', last_name)", " lower(first_name) "])
def test_expression_key(frame, text):
    a = frame(PEOPLE, ("Alice", "Smith", 100.0), ("Bob", "Jones", 200.0), ("Carol", "Lee", 300.0))
    b = frame(PEOPLE, ("Alice", "Smith", 100.5), ("Bob", "Jones", 200.0), ("Dave", "Kim", 400.0))
    comparison = compare(a, b, pk_expression=text)
    found = overview_of(comparison)
    assert (found["exclusive_a"], found["exclusive_b"], found["total_compared"]) == (1, 1, 2)
    # An expression excludes no column from the comparison.
    assert stats_of(comparison) == {"first_name": (0, 0), "last_name": (0, 0), "amount": (1, 0)}
    assert [r.first_name for r in comparison.only_in("a").collect()] == ["Carol"]
    assert [r.first_name for r in comparison.only_in_page("b").rows.collect()] == ["Dave"]
    assert comparison.diff_join().columns[:2] == ["pk_expr_a", "pk_expr_b"]


def test_expression_key_with_null(frame):
    schema = "name string, amount double"
    a, b = frame(schema, (None, 1.0), ("x", 2.0)), frame(schema, ("x", 2.0), ("y", 3.0))
    found = overview_of(compare(a, b, pk_expression="name"))
    assert (found["null_pks_a"], found["null_pks_b"]) == (1, 0)
    assert (found["exclusive_a"], found["exclusive_b"], found["total_compared"]) == (1, 1, 1)
    both = overview_of(compare(a, b, pk_expression="name", null_keys="both_sides"))
    assert (both["exclusive_a"], both["exclusive_b"], both["total_compared"]) == (1, 2, 0)


def test_expression_duplicates(frame):
    schema = "name string, tag string, amount double"
    a = frame(schema, ("Alice", "X", 1.0), ("Alice", "X", 2.0), ("Bob", "Y", 3.0))
    b = frame(schema, ("Alice", "X", 1.5), ("Bob", "Y", 3.0))
    comparison = compare(a, b, pk_expression="CONCAT(name, '_', tag)")
    found = overview_of(comparison)
    assert (found["duplicate_pks_a"], found["duplicate_pks_b"]) == (1, 0)
    assert [tuple(r) for r in comparison.duplicate_keys("a").collect()] == [("Alice_X", 2)]


def test_key_validation(frame):
    a, b = frame("id int, v int", (1, 1)), frame("id int, w int", (1, 1))
    with pytest.raises(ValueError, match="key is required"):
        DiffConfig()
    with pytest.raises(ValueError, match="not both"):
        DiffConfig(pk_columns=["id"], pk_expression="id")
    with pytest.raises(ValueError, match="semicolons"):
        DiffConfig(pk_expression="id; DROP TABLE x")
    with pytest.raises(ValueError, match="'v' does not exist in table B"):
        compare(a, b, pk_columns=["v"])
    with pytest.raises(ValueError, match="does not fit table B"):
        compare(a, b, pk_expression="v + 1")
    with pytest.raises(ValueError, match="Row filter does not fit table A"):
        compare(a, b, pk_columns=["id"], where_clause="w = 1")
    with pytest.raises(ValueError, match="twice"):
        DiffConfig(pk_columns=["id", "id"])


def test_repeated_keys_can_be_refused(frame):
    a, b = frame("id int, v int", (1, 1), (1, 2)), frame("id int, v int", (1, 1))
    with pytest.raises(ValueError, match="Keys repeat: 1 key values in A, 0 in B"):
        compare(a, b, pk_columns=["id"], on_duplicates="error").overview()


def test_where_clause(frame):
    schema = "id int, name string, amount double, status string"
    a = frame(schema, (1, "Alice", 100.0, "on"), (2, "Bob", 200.0, "on"), (3, "Carol", 300.0, "off"), (3, "C", 1.0, "off"))
    b = frame(schema, (1, "Alice", 110.0, "on"), (2, "Bob", 200.0, "on"), (3, "Carol", 350.0, "off"))
    found = overview_of(compare(a, b, pk_columns=["id"], where_clause="status = 'on'"))
    assert (found["total_rows_a"], found["total_rows_b"], found["total_compared"]) == (2, 2, 2)
    assert (found["rows_with_diffs"], found["rows_identical"], found["duplicate_pks_a"]) == (1, 1, 0)
    unfiltered = compare(a, b, pk_columns=["id"], where_clause="status = 'on'", where_scope="join")
    assert overview_of(unfiltered)["duplicate_pks_a"] == 1
    assert unfiltered.duplicate_keys("a").count() == 1
    assert overview_of(compare(a, b, pk_columns=["id"], where_clause="  "))["total_rows_a"] == 4


def test_ignored_columns(frame):
    schema = "id int, name string, status string"
    a, b = frame(schema, (1, "x", "p"), (2, "y", "q")), frame(schema, (1, "x", "r"), (2, "z", "s"))
    comparison = compare(a, b, pk_columns=["id"], ignored_columns=["status"])
    assert stats_of(comparison) == {"name": (1, 0)}
    assert comparison.diff_join().columns == [
        "pk_id_a", "pk_id_b", "name_a", "name_b", "status_a", "status_b", "is_diff_name", "is_raw_diff_name",
    ]
    with pytest.raises(ValueError, match="not in both"):
        compare(a, b, pk_columns=["id"], ignored_columns=["absent"])
    with pytest.raises(ValueError, match="cannot be ignored"):
        compare(a, b, pk_columns=["id"], ignored_columns=["id"])


def test_no_compared_columns(frame):
    a, b = frame("id int", (1,), (2,)), frame("id int", (2,), (3,))
    comparison = compare(a, b, pk_columns=["id"])
    found = overview_of(comparison)
    assert (found["total_compared"], found["rows_identical"], found["rows_with_diffs"]) == (1, 1, 0)
    assert comparison.column_stats().count() == 0
    assert (comparison.rows("diffs").count(), comparison.rows("same").count()) == (0, 1)
    assert comparison.cell_changes().count() == 0
    assert overview_of(compare(a, b, pk_columns=["id"], pair_budget=0.0)) == found


def test_no_matched_rows(frame):
    a, b = frame("id int, v int", (1, 1)), frame("id int, v int", (2, 1))
    for budget in (0.0, 1.0):
        row = compare(a, b, pk_columns=["id"], pair_budget=budget).column_stats().first()
        assert (row.diff_count, row.total, row.match_pct, row.diff_pct) == (0, 0, 100.0, 0.0)


def test_empty_tables(frame):
    a, b = frame("id int, v int"), frame("id int, v int")
    assert set(overview_of(compare(a, b, pk_columns=["id"])).values()) == {0}


def test_awkward_column_names(frame):
    schema = "`account_id` int, `pk_total` int, `a.b c` int, `x``y` int"
    a, b = frame(schema, (1, 1, 1, 1), (2, 2, 2, 2)), frame(schema, (1, 1, 5, 1), (2, 3, 2, 2))
    comparison = compare(a, b, pk_columns=["account_id"], ignored_columns=["x`y"])
    assert stats_of(comparison) == {"pk_total": (1, 0), "a.b c": (1, 0)}
    assert comparison.rows("diffs", "a.b c").count() == 1
    assert comparison.page("diffs").rows.count() == 2
    assert comparison.materialize().rows("diffs").count() == 2


def test_names_differing_by_case(spark, frame):
    a, b = frame("id int, Name string", (1, "x")), frame("id int, name string", (1, "y"))
    assert stats_of(compare(a, b, pk_columns=["id"])) == {}
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        twice = frame("id int, v int", (1, 1)).selectExpr("id", "v", "v as V")
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")
    with pytest.raises(ValueError, match="differ only by case"):
        compare(twice, twice, pk_columns=["id"])


def test_colliding_result_names(frame):
    a = frame("id int, pk_id int, v int", (1, 1, 1))
    with pytest.raises(ValueError, match="collide"):
        compare(a, a, pk_columns=["id"])


def test_type_mismatch(frame):
    a, b = frame("id int, v string, w int", (1, "10", 1)), frame("id bigint, v int, w double", (1, 10, 1.5))
    assert stats_of(compare(a, b, pk_columns=["id"])) == {"v": (0, 0), "w": (1, 0)}
    assert stats_of(compare(a, b, pk_columns=["id"], tolerance=0)) == {"v": (0, 0), "w": (0, 1)}
    assert stats_of(compare(a, b, pk_columns=["id"], on_type_mismatch="string")) == {"v": (0, 0), "w": (1, 0)}
    assert stats_of(compare(a, b, pk_columns=["id"], on_type_mismatch="skip")) == {}
    with pytest.raises(ValueError, match="'v' is string in A but int in B"):
        compare(a, b, pk_columns=["id"], on_type_mismatch="error")
    with pytest.raises(ValueError, match="do not compare"):
        compare(frame("id int, v boolean", (1, True)), frame("id int, v date", (1, None)), pk_columns=["id"])
