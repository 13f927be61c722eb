"""Table metadata, schema comparison and key candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META_SCHEMA = "ordinal int, name string, data_type string"
COMPARISON_SCHEMA = "ordinal int, name string, presence string, type_a string, type_b string, types_match boolean"


def table_meta(df: DataFrame) -> DataFrame:
    """One row per column in order: ``ordinal, name, data_type, row_count``."""
    columns = [(i, field.name, field.dataType.simpleString()) for i, field in enumerate(df.schema)]
    names = F.array(
        *[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("name"), F.lit(t).alias("data_type")) for i, n, t in columns]
    )
    counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select(F.inline(names), "row_count").select("ordinal", "name", "data_type", "row_count")


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns present in both tables under exactly the same name, in the order of ``a``."""
    in_b = set(b.columns)
    return [name for name in a.columns if name in in_b]


def compare_schemas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of both tables: shared ones in the order of ``a``, then those only in ``a``, then those only in ``b``."""
    types_a = {field.name: field.dataType.simpleString() for field in a.schema}
    types_b = {field.name: field.dataType.simpleString() for field in b.schema}
    shared = shared_columns(a, b)
    merged = (
        [(name, "shared") for name in shared]
        + [(name, "only_a") for name in types_a if name not in types_b]
        + [(name, "only_b") for name in types_b if name not in types_a]
    )
    rows = [
        (i, name, presence, types_a.get(name), types_b.get(name), types_a[name] == types_b[name])
        if presence == "shared"
        else (i, name, presence, types_a.get(name), types_b.get(name), None)
        for i, (name, presence) in enumerate(merged)
    ]
    return a.sparkSession.createDataFrame(rows, COMPARISON_SCHEMA)


def key_candidates(a: DataFrame, b: DataFrame) -> list[str]:
    """Shared columns named ``id`` or ending in ``_id``, in any case."""
    return [name for name in shared_columns(a, b) if name.lower() == "id" or name.lower().endswith("_id")]


SUGGESTION_SCHEMA = (
    "ordinal int, name string, rows_a long, rows_b long, distinct_a long, distinct_b long, "
    "nulls_a long, nulls_b long, unique_a boolean, unique_b boolean"
)
# Columns of one grouping: their sets are told apart by the bits of a 64-bit number.
GROUPED_TOGETHER = 60


def suggest_keys(a: DataFrame, b: DataFrame, candidates: list[str] | None = None) -> DataFrame:
    """Key candidates with the facts that decide on them, per side: rows, distinct values, NULLs, uniqueness.

    One grouping over both tables, with a grouping set for each candidate, reads each table once and counts each value
    once per candidate, whatever their skew.
    """
    names = key_candidates(a, b) if candidates is None else list(candidates)
    if not names:
        return a.sparkSession.createDataFrame([], SUGGESTION_SCHEMA)
    starts = range(0, len(names), GROUPED_TOGETHER)
    return reduce(DataFrame.unionAll, [_key_facts(a, b, names[x : x + GROUPED_TOGETHER], x) for x in starts])


def _key_facts(a: DataFrame, b: DataFrame, names: list[str], first: int) -> DataFrame:
    columns = [f"c{i}" for i in range(len(names))]
    sides = [
        df.select(*[F.col(quoted(n)).alias(c) for n, c in zip(names, columns, strict=True)], F.lit(x).alias("a"), F.lit(1 - x).alias("b"))
        for df, x in ((a, 1), (b, 0))
    ]
    counts = (
        sides[0]
        .unionAll(sides[1])
        .groupingSets([[c] for c in columns], *columns)
        .agg(F.grouping_id().alias("absent"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    facts = {}
    for i, c in enumerate(columns):
        # In the set of a column its own bit alone is 0; the first column has the highest.
        own = F.col("absent") == (1 << len(columns)) - 1 - (1 << len(columns) - 1 - i)
        known = own & F.col(c).isNotNull()
        for side in ("a", "b"):
            n = F.col(side)
            facts |= {
                f"rows_{side}_{i}": F.coalesce(F.sum(F.when(own, n)), F.lit(0)),
                f"distinct_{side}_{i}": F.count_if(known & (n > 0)),
                f"nulls_{side}_{i}": F.coalesce(F.sum(F.when(own & ~known, n)), F.lit(0)),
                f"unique_{side}_{i}": ~F.coalesce(F.max(F.when(known, n) > 1), F.lit(False)),
            }
    labels = [f"{fact}_{side}" for fact in ("rows", "distinct", "nulls", "unique") for side in ("a", "b")]
    rows = [
        F.struct(F.lit(first + i).alias("ordinal"), F.lit(name).alias("name"), *[F.col(f"{x}_{i}").alias(x) for x in labels])
        for i, name in enumerate(names)
    ]
    return counts.agg(*[value.alias(label) for label, value in facts.items()]).select(F.inline(F.array(*rows)))


def quoted(name: str) -> str:
    """A column name that Spark takes literally, dots and spaces included."""
    return "`" + name.replace("`", "``") + "`"
