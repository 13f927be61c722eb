from __future__ import annotations

from twinframe import compare, compare_schemas, key_candidates, suggest_keys, table_meta
from twinframe.operators import schema


def test_schema_comparison(frame):
    a, b = frame("id int, x string, only_left int"), frame("only_right date, x string, id bigint")
    assert [tuple(r) for r in compare_schemas(a, b).collect()] == [
        (0, "id", "shared", "int", "bigint", False),
        (1, "x", "shared", "string", "string", True),
        (2, "only_left", "only_a", "int", None, None),
        (3, "only_right", "only_b", None, "date", None),
    ]
    assert compare(a, b, pk_columns=["id"]).schema().count() == 4


def test_names_are_case_sensitive(frame):
    found = {r["name"]: r.presence for r in compare_schemas(frame("Id int"), frame("id int")).collect()}
    assert found == {"Id": "only_a", "id": "only_b"}


def test_table_meta(frame):
    df = frame("id int, `a.b` array<string>", (1, ["x"]), (2, None))
    assert [tuple(r) for r in table_meta(df).collect()] == [(0, "id", "int", 2), (1, "a.b", "array<string>", 2)]


def test_key_suggestions(frame):
    columns = "ID int, order_id int, Line_Id int, identity int, id_x int"
    a = frame(columns, (1, 1, None, 1, 1), (2, 1, 2, 1, 1))
    b = frame(columns, (1, 1, 3, 1, 1))
    assert key_candidates(a, b) == ["ID", "order_id", "Line_Id"]
    found = {r["name"]: r for r in suggest_keys(a, b).collect()}
    assert list(found) == ["ID", "order_id", "Line_Id"]
    assert (found["ID"].unique_a, found["order_id"].unique_a, found["Line_Id"].unique_a) == (True, False, True)
    row = found["Line_Id"]
    assert (row.rows_a, row.rows_b, row.distinct_a, row.distinct_b, row.nulls_a, row.nulls_b) == (2, 1, 1, 1, 1, 0)
    assert suggest_keys(frame("v int"), frame("v int")).isEmpty()


def test_key_suggestions_of_empty_tables_and_of_many_columns(frame, monkeypatch):
    a, b = frame("x_id int, y_id string"), frame("x_id bigint, y_id string")
    assert [tuple(r) for r in suggest_keys(a, b).collect()] == [
        (i, name, 0, 0, 0, 0, 0, 0, True, True) for i, name in enumerate(["x_id", "y_id"])
    ]
    names = [f"c{i}_id" for i in range(7)]
    wide = frame(", ".join(f"{name} int" for name in names), tuple(range(7)), (0, None, 2, 0, 0, None, 6), (None,) * 7)
    together = suggest_keys(wide, wide.limit(1)).collect()
    assert [r["name"] for r in together] == names
    assert [(r.distinct_a, r.nulls_a, r.unique_a, r.rows_b) for r in together[:4]] == [(1, 1, False, 1), (1, 2, True, 1), (1, 1, False, 1), (2, 1, True, 1)]
    monkeypatch.setattr(schema, "GROUPED_TOGETHER", 3)
    assert suggest_keys(wide, wide.limit(1)).collect() == together


def test_key_suggestions_read_each_table_once(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    found = suggest_keys(orders, orders.limit(10**9), ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"])
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
