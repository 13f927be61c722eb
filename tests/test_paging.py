from __future__ import annotations

import random

import pytest

from twinframe import compare
from twinframe.operators.audit import ActivityLog
from twinframe.operators.paging import paged


def test_pages_follow_each_other(frame):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"]), i % 30, {"m": i}) for i in range(230)]
    df = frame("k int, `s.t` string, i int, m map<string,int>", *rows).repartition(6)
    found = paged(df.drop("m"), ["k", "s.t"], rows_per_file=11)
    expected = df.drop("m").orderBy("k", "`s.t`", "i").collect()
    assert found.total == 230
    for size in (1, 7, 50, 229, 230, 500):
        for n in {0, 1, 229 // size, 230 // size, 900}:
            page = found.page(n, size)
            assert page.rows.collect() == expected[n * size : (n + 1) * size], (size, n)
            assert page.total == 230
    files = found.files.orderBy("start").collect()
    assert max(f.rows for f in files) <= 11 and [f.start for f in files[1:]] == [f.start + f.rows for f in files[:-1]]
    # Columns that cannot be sorted are carried along.
    assert sorted(r.m["m"] for n in range(3) for r in paged(df, ["i"]).page(n, 100).rows.collect()) == list(range(230))


def test_the_page_of_a_key(frame):
    keys = [None] * 3 + [1] * 20 + [2] * 2 + [5] * 40 + [9]
    df = frame("k int, v int", *[(k, i) for i, k in enumerate(keys)])
    found = paged(df, ["k"], rows_per_file=4)
    for key in (None, 0, 1, 2, 3, 5, 9, 10):
        below = 0 if key is None else sum(k is None or k < key for k in keys)
        assert found.page_number({"k": key}, 6) == below // 6, key
    assert [r.v for r in found.page_at({"k": 5}, 6).rows.collect()] == list(range(24, 30))


def test_empty_rows_and_wrong_numbers(frame):
    found = paged(frame("k int, v int"), ["k"])
    assert (found.total, found.page().rows.count(), found.page_number({"k": 1})) == (0, 0, 0)
    assert found.page().rows.columns == ["k", "v"]
    with pytest.raises(ValueError, match="page"):
        found.page(-1)


def test_a_far_page_reads_no_more_files_than_the_first(spark):
    found = paged(spark.range(20_000).selectExpr("id", "id % 7 AS v"), ["id"], rows_per_file=1000)
    assert found.files.count() >= 20
    for n in (0, 190, 399):
        rows = found.page(n, 50).rows
        assert len(rows.inputFiles()) <= 2
        assert [r.id for r in rows.collect()] == list(range(50 * n, 50 * n + 50))


def test_paged_comparison(spark, frame, tmp_path):
    a = frame("id int, v int", *[(i % 50, i) for i in range(200)])
    b = frame("id int, v int", *[(i % 50, i + 1) for i in range(200)])
    log = ActivityLog(spark)
    comparison = compare(a, b, log=log, pk_columns=["id"], on_duplicates="pairs")
    found = comparison.paged("diffs", path=str(tmp_path / "pages"), rows_per_file=30)
    assert found.total == comparison.rows("diffs").count() > 600
    for n in (0, 3, 7):
        assert found.page(n, 90).rows.collect() == comparison.page("diffs", page=n, page_size=90).rows.collect()
    assert [(r.operation, r.rows_affected) for r in log.entries().collect()] == [("paged", found.total)]


def test_each_file_is_opened_once(spark, monkeypatch):
    """One scan finds the first rows of all files; after it, only the last file that each task wrote is read."""
    from twinframe.operators import paging

    read = []

    def noting(df, label, path=None):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        read.append((plan.count("Relation ["), sum("/rows/" in name for name in df.inputFiles())))
        return stored(df, label, path)

    stored = paging.stored
    monkeypatch.setattr(paging, "stored", noting)
    found = paged(spark.range(5000).selectExpr("id % 50 AS k", "id AS v"), ["k"], rows_per_file=100)
    files = found.files.count()
    assert read[0] == (1, files) and all(n <= 4 for _, n in read[1:]) and files >= 50
    assert found.total == 5000
    assert [tuple(r) for r in found.page(7, 300).rows.collect()] == sorted((i % 50, i) for i in range(5000))[2100:2400]


@pytest.mark.parametrize("most", [250_000, 20])
def test_rows_are_shuffled_in_order_before_they_are_paired(frame, monkeypatch, most):
    """All pairs are made where the rows of a range of keys are, unless one key has many; pages are those of a global sort."""
    from twinframe.operators import paging, pairs

    zero, nan = [-0.0, 0.0], float("nan")
    keys = [None, nan, *zero, 1.0, 2.0, 2.0, 3.0]
    a = frame("id double, `a` int, m map<string,int>, only_a int", *[(keys[i % 8], i, {"m": i % 3}, i) for i in range(60)])
    b = frame("id double, `a` int, m map<string,int>", *[(keys[i * 3 % 8] if i % 5 else 7.0, i % 9, {"m": i % 2}) for i in range(50)])
    taken = []

    def noting(df, order, path, rows_per_file, ranged):
        taken.append((ranged, df._jdf.queryExecution().executedPlan().toString()))
        return paged(df, order, path, rows_per_file, ranged)

    monkeypatch.setattr(paging, "paged", noting)
    monkeypatch.setattr(pairs, "ONE_TASK_PAIRS", most)
    comparison = compare(a, b, pk_columns=["id"], on_duplicates="pairs")
    found = comparison.paged("all", rows_per_file=25)
    (ranged, plan), = taken
    assert ranged == (most > 20)
    if ranged:
        assert plan.count("Exchange rangepartitioning") == plan.count("Exchange ") == 1 and "Join" not in plan
    # str tells -0.0 from 0.0 and finds NaN equal to itself; rows that tie in all sortable columns may change places.
    sortable = [c for c in found.rows.columns if not c.startswith(("m_", "is_"))]
    text = lambda rows, names: [str([r[c] for c in names]) for r in rows]
    expected = comparison.rows("all")
    assert found.total == expected.count() > 250
    assert sorted(text(found.rows.collect(), expected.columns)) == sorted(text(expected.collect(), expected.columns))
    assert found.rows.columns == expected.columns
    ordered = text(expected.orderBy(*[f"`{c}`" for c in sortable]).collect(), [c for c in sortable if not c.startswith("pk_")])
    assert [x for n in range(found.total // 40 + 1) for x in text(found.page(n, 40).rows.collect(), [c for c in sortable if not c.startswith("pk_")])] == ordered


def test_pages_of_all_pairs_with_no_pairs(frame):
    a, b = frame("id int, v int", (1, 1), (None, 2)), frame("id int, v int", (2, 1), (None, 2))
    for one, other in ((a, b), (a.limit(0), b), (a.limit(0), b.limit(0))):
        found = compare(one, other, pk_columns=["id"], on_duplicates="pairs").paged("all")
        assert (found.total, found.page().rows.count()) == (0, 0)
