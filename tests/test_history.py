from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from twinframe.functions.text import redacted
from twinframe.operators.audit import ActivityLog
from twinframe.operators.history import (
    cleared,
    insert_new,
    newest,
    newest_per_group,
    read_history,
    retained,
    upserted,
    without_entry,
)

T0 = datetime(2024, 1, 1)
LOG = "connection_id string, query string, used_at timestamp_ntz"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_upsert_keeps_the_first_and_the_latest_use(frame):
    log = frame(
        LOG,
        ("c1", "SELECT 1", at(0)),
        ("c1", "  SELECT 1\n", at(5)),
        ("c2", "SELECT 1", at(2)),
        (None, "SELECT 1", at(3)),
        (None, "SELECT 1", at(4)),
        ("c1", " \t", at(9)),
    )
    entries = {r.connection_id: r for r in upserted(log).collect()}
    assert len(entries) == 3
    assert (entries["c1"].created_at, entries["c1"].last_used_at) == (at(0), at(5))
    assert (entries[None].created_at, entries[None].last_used_at) == (at(3), at(4))
    assert len({r.id for r in entries.values()}) == 3


def test_retention(frame):
    log = frame(LOG, *[(c, f"q{i}", at(i)) for c in ("x", "y", None) for i in range(51)])
    kept = retained(upserted(log)).collect()
    assert len(kept) == 150 and "q0" not in {r.query for r in kept}
    many = frame(LOG, *[(f"c{c}", f"q{i}", at(100 * c + i)) for c in range(12) for i in range(50)])
    kept = retained(upserted(many)).collect()
    assert len(kept) == 500 and {r.connection_id for r in kept} == {f"c{c}" for c in range(2, 12)}


def test_reading_and_clearing(frame):
    history = upserted(frame(LOG, ("c1", "a", at(1)), ("c1", "b", at(2)), ("c2", "c", at(3)), (None, "d", at(4))))
    assert [r.query for r in read_history(history).collect()] == ["d", "c", "b", "a"]
    assert [r.query for r in read_history(history, "c1").collect()] == ["b", "a"]
    entry = history.where("query = 'a'").first().id
    assert without_entry(history, entry).count() == 3
    assert {r.query for r in cleared(history, "c1").collect()} == {"c", "d"}
    assert cleared(history).isEmpty()


def test_top_k_plans_cut_before_the_shuffle(frame):
    df = frame("g string, t int, i int", *[("g", n, n) for n in range(10)])
    per_group = newest_per_group(df, "g", [F.col("t").desc(), F.col("i")], 3)
    assert sorted(r.t for r in per_group.collect()) == [7, 8, 9]
    plan = per_group._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert [r.t for r in newest(df, [F.col("t").desc()], 2).collect()] == [9, 8]


def test_insert_new(frame):
    schema = "name string, port int"
    existing = frame(schema, ("prod", 1))
    incoming = frame(schema, ("prod", 2), ("dev", 3), ("dev", 4), (None, 5))
    combined, skipped = insert_new(existing, incoming, "name")
    assert sorted(r.port for r in combined.collect()) == [1, 3, 4, 5]
    assert [tuple(r) for r in skipped.collect()] == [("prod", 2)]


def test_redaction(frame):
    cases = {
        "KEY_ID 'AK1', SECRET 's2'": "KEY_ID '***', SECRET '***'",
        "SECRET 'a' then SECRET 'b'": "SECRET '***' then SECRET '***'",
        "SESSION_TOKEN 't', KEY 'k'": "SESSION_TOKEN '***', KEY '***'",
        "MAP {'Authorization': 'Bearer abc'}": "MAP {'Authorization': 'Bearer ***'}",
        "SECRET 'open": "SECRET 'open",
        "SELECT 'plain'": "SELECT 'plain'",
    }
    df = frame("s string", *[(s,) for s in cases])
    assert {r.s: r.r for r in df.select("s", redacted(F.col("s")).alias("r")).collect()} == cases


def test_activity_log(spark, tmp_path):
    log = ActivityLog(spark)
    with log.record("load", "SECRET 'x'") as outcome:
        outcome.rows = 7
    with pytest.raises(RuntimeError), log.record("diff", "SELECT 1"):
        raise RuntimeError("bad KEY 'k'")
    first, second = log.entries().collect()
    assert (first.operation, first.sql, first.rows_affected, first.error) == ("load", "SECRET '***'", 7, None)
    assert (second.rows_affected, second.error) == (None, "bad KEY '***'")
    assert first.duration_ms >= 0 and first.timestamp > 1_600_000_000_000
    log.append_to(str(tmp_path / "log"))
    assert log.entries().isEmpty()
    with log.record("again"):
        pass
    log.append_to(str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3
    log.clear()
