"""Every registered query on tables against its SQL counterpart on DuckDB."""

from __future__ import annotations

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from catalog.duckdb_sql import ORACLES
from catalog.spark_queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def normal(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return str([normal(v) for v in value])
    return str(value)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(tuple(map(normal, row)) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert found == sorted(tuple(normal(row[i]) for i in places) for row in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(ORACLES) == set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_text_part():
    """The text part needs modules that this part does not: without them the rest is still there."""
    program = "import sys; sys.modules['regex'] = None; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", program], cwd=Path(entry.__file__).parent, capture_output=True, text=True, check=True)
    assert int(done.stdout) == len(QUERIES)
