from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from twinframe.operators.history import StoredHistory, insert_new_into
from twinframe.operators.versions import VersionedTable

LOG = "connection_id string, query string, used_at timestamp_ntz"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_versions_replace_each_other(spark, frame, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.version == 0 and table.versions().isEmpty()
    with pytest.raises(ValueError, match="no version"):
        table.read()
    assert table.replace(frame("id int, `a b` array<string>", (1, ["x"]), (2, None))) == 2
    first = table.read()
    assert table.change(lambda rows: rows.where("id = 2").withColumn("more", F.lit(1.5))) == 1
    assert [tuple(r) for r in table.read().collect()] == [(2, None, 1.5)]
    assert first.count() == 2 and table.read(1).columns == ["id", "a b"]
    assert table.replace(table.read().limit(0)) == 0 and table.read().columns == ["id", "a b", "more"]
    assert [(r.version, r.rows) for r in table.versions().orderBy("version").collect()] == [(1, 2), (2, 1), (3, 0)]
    assert table.vacuum(keep=2) == 1
    assert table.read(2).count() == 1 and table.read().count() == 0


@pytest.mark.parametrize("failing", ["rows", "commit"])
def test_a_failure_leaves_the_old_version(spark, frame, tmp_path, monkeypatch, failing):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.replace(frame("id int", (1,), (2,)))
    with monkeypatch.context() as patched:
        if failing == "commit":
            patched.setattr(VersionedTable, "_commit", lambda *_: 1 / 0)
            step = lambda rows: rows.where("id = 1")
        else:
            step = lambda rows: rows.select(F.raise_error(F.lit("lost")).cast("int").alias("id"))
        with pytest.raises(Exception, match="lost|division"):
            table.change(step)
    assert (table.version, table.read().count()) == (1, 2)
    assert table.change(lambda rows: rows.where("id = 1")) == 1
    assert (table.version, table.read().first().id) == (2, 1)


def test_stored_history(spark, frame, tmp_path):
    history = StoredHistory(spark, str(tmp_path / "h"))
    assert history.add(frame(LOG, ("c1", " a ", at(1)), ("c1", "b", at(2)), (None, "d", at(3)), ("c1", "  ", at(4)))) == 3
    assert history.add(frame(LOG, ("c1", "a", at(9)), ("c2", "c", at(5)))) == 4
    rows = history.read().collect()
    assert [(r.query, r.created_at, r.last_used_at) for r in rows[:2]] == [("a", at(1), at(9)), ("c", at(5), at(5))]
    assert [r.query for r in history.read("c1").collect()] == ["a", "b"]
    assert history.delete(rows[0].id) == 3
    assert history.clear("c1") == 2
    assert {r.connection_id for r in history.read().collect()} == {"c2", None}
    assert history.clear() == 0 and history.read().isEmpty()


def test_stored_history_keeps_the_newest(spark, frame, tmp_path):
    history = StoredHistory(spark, str(tmp_path / "h"))
    history.add(frame(LOG, *[("c1", f"q{i}", at(i)) for i in range(50)]))
    assert history.add(frame(LOG, ("c1", "new", at(99)), ("c2", "other", at(0)))) == 51
    assert {r.query for r in history.read("c1").collect()} == {"new", *[f"q{i}" for i in range(1, 50)]}


def test_insert_new_into_a_stored_table(spark, frame, tmp_path):
    schema = "name string, port int"
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.replace(frame(schema, ("prod", 1)))
    skipped = insert_new_into(table, frame(schema, ("prod", 2), ("dev", 3), (None, 5)), "name")
    assert sorted(r.port for r in table.read().collect()) == [1, 3, 5]
    assert [tuple(r) for r in skipped.collect()] == [("prod", 2)]
