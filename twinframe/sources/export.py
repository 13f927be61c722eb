"""Sinks: any result frame as CSV, Parquet or JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.operators.schema import quoted
from twinframe.sources.files import CSV_DIALECT, FORMATS

EXPORT_FORMATS = ("csv", "parquet", "json")


def export_format(path: str, fmt: str | None = None) -> str:
    """The format asked for, else the one the ending of ``path`` names, else CSV."""
    if fmt is None:
        return next((known for ending, known in FORMATS.items() if path.lower().endswith(ending)), "csv")
    if fmt not in EXPORT_FORMATS:
        raise ValueError(f"Export format must be one of {', '.join(EXPORT_FORMATS)}, not {fmt!r}")
    return fmt


def export(
    df: DataFrame,
    path: str,
    fmt: str | None = None,
    order: list[str] | None = None,
    single_file: bool = False,
    mode: str = "errorifexists",
) -> int:
    """Write ``df`` to the folder ``path`` and return the number of rows, counted in the same job.

    ``order`` sorts the output across its part files (a range partitioning, no single task). ``single_file`` writes
    one part file and is for small results only, as one task then writes everything.
    """
    fmt = export_format(path, fmt)
    out = df if fmt == "parquet" else df.select(*[_text_value(field, fmt) for field in df.schema])
    by = [F.col(quoted(name)) for name in order or []]
    if single_file:
        out = out.repartition(1).sortWithinPartitions(*by) if by else out.repartition(1)
    elif by:
        out = out.orderBy(*by)
    # Observed last: sorting samples its input first, which would count rows twice.
    counted = Observation()
    writer = out.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode(mode)
    if fmt == "csv":
        writer.options(header=True, **CSV_DIALECT).csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).options(**FULL_PRECISION).json(path)
    else:
        writer.parquet(path)
    return counted.get["rows"]


FULL_PRECISION = {
    "timestampFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS][XXX]",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
}


def _text_value(field: T.StructField, fmt: str) -> Column:
    """Timestamps as text with all their digits; for CSV, which has no nested values, those as JSON text."""
    column = F.col(quoted(field.name))
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return column.cast("string").alias(field.name)
    if fmt == "csv" and isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column, FULL_PRECISION).alias(field.name)
    return column
