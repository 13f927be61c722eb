from __future__ import annotations

import json
import random
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from twinframe import CaseInsensitive, Precision, compare
from twinframe.functions import chars
from twinframe.operators.audit import ActivityLog
from twinframe.operators.drill import page_after, page_of

SCHEMA = "id int, amount double, status string"
A = [(1, 100.1, "x"), (2, 200.0, "Y"), (3, 300.0, "z"), (4, 1.0, None), (5, 5.0, "only a")]
B = [(1, 100.9, "x"), (2, 250.0, "y"), (3, 300.0, "z"), (4, 1.0, "new"), (6, 6.0, "only b")]


@pytest.fixture
def comparison(frame):
    tolerances = {"amount": Precision(0), "status": CaseInsensitive()}
    return compare(frame(SCHEMA, *A), frame(SCHEMA, *B), pk_columns=["id"], column_tolerances=tolerances)


def ids(df):
    return sorted(r.pk_id_a for r in df.collect())


def test_row_classes(comparison):
    assert ids(comparison.rows("all")) == [1, 2, 3, 4]
    assert ids(comparison.rows()) == [2, 4]
    assert ids(comparison.rows("minor")) == [1]
    assert ids(comparison.rows("same")) == [3]
    with pytest.raises(ValueError, match="Row class"):
        comparison.rows("exclusive")


def test_column_filter(comparison):
    assert ids(comparison.rows("diffs", "amount")) == [2]
    assert ids(comparison.rows("minor", "amount")) == [1]
    # On the level of one column, a row with a real difference elsewhere can be minor.
    assert ids(comparison.rows("minor", "status")) == [2]
    assert ids(comparison.rows("all", "amount")) == [1, 2, 3, 4]
    assert ids(comparison.rows("same", "amount")) == [3]
    with pytest.raises(ValueError, match="not compared"):
        comparison.rows("diffs", "id")


def test_drill_down_columns(comparison):
    names = ["pk_id_a", "pk_id_b", "amount_a", "amount_b", "status_a", "status_b"]
    flags = ["is_diff_amount", "is_diff_status", "is_raw_diff_amount", "is_raw_diff_status"]
    assert comparison.rows().columns == names + flags
    assert comparison.rows(flags=False).columns == names
    assert dict(comparison.rows().dtypes)["is_diff_amount"] == "int"


def test_pages(comparison, spark):
    first = comparison.page("all", page=0, page_size=3)
    assert [r.pk_id_a for r in first.rows.collect()] == [1, 2, 3]
    assert first.total == 4
    assert [r.pk_id_a for r in comparison.page("all", page=1, page_size=3).rows.collect()] == [4]
    wide = spark.range(5000)
    assert page_of(wide, ["id"], 0, 4000).rows.count() == 4000
    assert page_of(wide, ["id"], 1, 4000).rows.first().id == 4000
    with pytest.raises(ValueError, match="page"):
        page_of(wide, ["id"], -1)


def test_page_as_json(comparison):
    row = json.loads(comparison.page("diffs").json().orderBy("row").first().row)
    assert set(row) == set(comparison.rows().columns)
    assert row["is_diff_status"] in (0, 1)
    shown = [json.loads(r.row) for r in comparison.page("diffs").json().collect()]
    assert {r["status_a"] for r in shown} == {"Y", None}


def test_keyset_paging_walks_over_all_rows(frame):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"]), i) for i in range(40)]
    df = frame("k int, s string, i int", *rows)
    order = ["k", "s", "i"]
    seen, last = [], None
    page = page_of(df, order, 0, 7).rows.collect()
    while page:
        seen += [tuple(r) for r in page]
        last = page[-1].asDict()
        page = page_after(df, order, last, 7).collect()
    expected = df.orderBy(*order).collect()
    assert seen == [tuple(r) for r in expected]


def test_pages_of_repeated_keys_do_not_overlap(frame):
    a = frame("id int, v int", *[(1, i) for i in range(10)])
    b = frame("id int, v int", *[(1, i + 100) for i in range(10)])
    comparison = compare(a, b, pk_columns=["id"], on_duplicates="pairs")
    pages = [comparison.page("diffs", page=n, page_size=30).rows.collect() for n in range(4)]
    assert [len(p) for p in pages] == [30, 30, 30, 10]
    assert len({tuple(r) for p in pages for r in p}) == 100
    walked = list(pages[0])
    while rest := comparison.page_after(walked[-1].asDict(), page_size=7).collect():
        walked += rest
    assert walked == [r for p in pages for r in p]
    with pytest.raises(ValueError, match="not total"):
        page_after(comparison.rows(), comparison.order, {"pk_id_a": 1})


def test_keyset_pages_split_equal_rows(frame):
    df = frame("k int, s string", *[(1, "x")] * 5, (2, "y"), *[(3, "z")] * 2)
    walked, seen = page_of(df, ["k", "s"], 0, 2).rows.collect(), 2
    while rest := page_after(df, ["k", "s"], walked[-1].asDict(), 2, seen).collect():
        walked += rest
        seen = next(i for i in range(1, len(walked) + 1) if i == len(walked) or walked[-i - 1] != walked[-1])
    assert walked == df.orderBy("k", "s").collect()


def test_cell_changes(comparison):
    found = {(r.pk_id, r["column"]): (r.a, r.b, r["class"]) for r in comparison.cell_changes().collect()}
    assert found == {
        (1, "amount"): ("100.1", "100.9", "minor"),
        (2, "amount"): ("200.0", "250.0", "diff"),
        (2, "status"): ("Y", "y", "minor"),
        (4, "status"): (None, "new", "diff"),
    }
    assert comparison.cell_changes(minor=False).count() == 2


def test_cell_changes_with_display_precision(frame):
    a, b = frame("id int, v double", (1, 1.999), (2, 5.0)), frame("id int, v double", (1, -1.25), (2, 6.0))
    found = compare(a, b, pk_columns=["id"]).cell_changes(display_precision=1)
    assert sorted((r.a, r.b) for r in found.collect()) == [("1.9", "-1.2"), ("5.0", "6.0")]


def test_export_and_log(spark, frame, tmp_path):
    a, b = frame("id int, v int", (2, 1), (1, 1), (3, 1)), frame("id int, v int", (1, 2), (2, 3), (3, 1))
    log = ActivityLog(spark)
    comparison = compare(a, b, pk_columns=["id"], where_clause="id > 0", log=log).run()
    assert comparison.export(str(tmp_path / "d.json")) == 2
    assert comparison.export(str(tmp_path / "s"), "parquet", which="same") == 1
    comparison.materialize()
    with pytest.raises(ValueError):
        comparison.export(str(tmp_path / "x"), "xlsx")
    entries = [(r.operation, r.sql, r.rows_affected) for r in log.entries().collect()]
    assert [e[0] for e in entries] == ["statistics", "export", "export", "materialize", "export"]
    assert [e[2] for e in entries] == [3, 2, 1, None, None]
    assert entries[0][1] == "KEY id WHERE id > 0"


def test_char_changes(comparison):
    for row in comparison.char_changes().collect():
        a, b = row.a or "NULL", row.b or "NULL"
        assert "".join(p.text for p in row.parts_a) == a and "".join(p.text for p in row.parts_b) == b
        assert {p.kind for p in row.parts_a} <= {"kept", "removed"}
        assert {p.kind for p in row.parts_b} <= {"kept", "added"}


def longest_common(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next_row(row, x, b)
    return row[-1]


def _next_row(row, x, b):
    new = [0]
    for j, y in enumerate(b):
        new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
    return new


@pytest.mark.parametrize("table_bits", [1 << 28, 16, 1])
def test_edit_scripts_are_shortest(monkeypatch, table_bits):
    monkeypatch.setattr(chars, "TABLE_BITS", table_bits)
    rng = random.Random(table_bits)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randrange(15))) for _ in range(2))
        parts = chars.edit_parts(a, b)
        assert "".join(p["text"] for p in parts if p["kind"] != "added") == a
        assert "".join(p["text"] for p in parts if p["kind"] != "removed") == b
        assert sum(len(p["text"]) for p in parts if p["kind"] == "kept") == longest_common(a, b)
        assert all(x["kind"] != y["kind"] for x, y in zip(parts, parts[1:], strict=False))


@pytest.mark.parametrize("few", [0, 10**6])
def test_edit_scripts_are_shortest_by_search_and_by_table(monkeypatch, few):
    monkeypatch.setattr(chars, "isqrt", lambda n: few)
    rng = random.Random(few)
    for _ in range(1000):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(rng.choice([4, 15, 40])))) for _ in range(2))
        parts = chars.edit_parts(a, b)
        assert "".join(p["text"] for p in parts if p["kind"] != "added") == a
        assert "".join(p["text"] for p in parts if p["kind"] != "removed") == b
        assert sum(len(p["text"]) for p in parts if p["kind"] == "kept") == longest_common(a, b)


def test_edit_script_of_long_texts_takes_time_by_their_edits(monkeypatch):
    monkeypatch.setattr(chars, "_rows", None)
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh ") for _ in range(1_000_000))
    places = sorted(rng.sample(range(0, len(a), 1000), 100))
    b = "".join(a[i:j] + "X" for i, j in zip([0, *places[:-1]], places, strict=True)) + a[places[-1] :]
    parts = chars.edit_parts(a, b)
    assert [p["text"] for p in parts if p["kind"] == "added"] == ["X"] * 100
    assert "".join(p["text"] for p in parts if p["kind"] == "kept") == a


def test_edit_script_runs_where_the_package_is_not_installed(tmp_path):
    (tmp_path / "f.pickle").write_bytes(cloudpickle.dumps(chars.edit_parts))
    code = "import pickle; print(pickle.load(open('f.pickle', 'rb'))('ab', 'b'))"
    out = subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert "'kind': 'removed'" in out.stdout, out.stderr
