"""The text queries that SQL can express, against DuckDB on the whole small tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from twinframe.llm.oracles import ORACLES
from twinframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(map(str, df.select(columns).collect()))
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    row = df.select(columns).limit(0)
    del row
    from pyspark.sql import Row

    wanted = sorted(str(Row(**{c: r[names.index(c)] for c in columns})) for r in result.fetchall())
    assert found == wanted
