"""Query sources: SQL that runs on a remote database, its result read through JDBC.

The driver jar and the connection settings come from the caller. One connection reads a plain query; a partition column
or a list of predicates spreads the read over ``num_partitions`` tasks, which large results need.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def query_options(url: str, query: str, **options: Any) -> dict[str, str]:
    """Options of a JDBC read of ``query``."""
    text = query.strip().rstrip(";").strip()
    if not text:
        raise ValueError("The query is empty")
    if not url.startswith("jdbc:"):
        raise ValueError("The URL must start with jdbc:")
    return {"url": url, "query": text, **{name: str(value) for name, value in options.items()}}


def partitioned_options(
    url: str, query: str, column: str, lower: Any, upper: Any, num_partitions: int, **options: Any
) -> dict[str, str]:
    """Options of a JDBC read of ``query`` split on ``column``; rows outside the bounds go to the end partitions."""
    if num_partitions < 1:
        raise ValueError("num_partitions must be positive")
    plain = query_options(url, query, **options)
    table = f"({plain.pop('query')}) source"
    return plain | {
        "dbtable": table,
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(num_partitions),
    }


def read_query(
    spark: SparkSession,
    url: str,
    query: str,
    partition_column: str | None = None,
    bounds: tuple[Any, Any] | None = None,
    num_partitions: int | None = None,
    predicates: Sequence[str] | None = None,
    **options: Any,
) -> DataFrame:
    """Read the result of ``query``.

    With ``partition_column`` the read is split into ``num_partitions`` ranges; missing ``bounds`` are asked of the
    database first. With ``predicates`` there is one task per predicate, which must be disjoint and complete.
    """
    if predicates:
        plain = query_options(url, query, **options)
        table = f"({plain.pop('query')}) source"
        return spark.read.jdbc(plain.pop("url"), table, predicates=list(predicates), properties=plain)
    if partition_column is None:
        return spark.read.format("jdbc").options(**query_options(url, query, **options)).load()
    if num_partitions is None:
        raise ValueError("num_partitions is required with partition_column")
    if bounds is None:
        text = query_options(url, query)["query"]
        span = f"SELECT MIN({partition_column}) AS low, MAX({partition_column}) AS high FROM ({text}) source"
        bounds = tuple(spark.read.format("jdbc").options(**query_options(url, span, **options)).load().first())
        if bounds[0] is None:
            return read_query(spark, url, query, **options)
    split = partitioned_options(url, query, partition_column, *bounds, num_partitions, **options)
    return spark.read.format("jdbc").options(**split).load()
