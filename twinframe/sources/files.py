"""File sources: CSV, Parquet and JSON under any URI that Hadoop can open.

Credentials and endpoints are Spark configuration (``spark.hadoop.fs.s3a.*``, ``spark.hadoop.fs.gs.*``), not arguments.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.operators.schema import quoted

# File name endings and the format each stands for.
FORMATS = {".parquet": "parquet", ".pq": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json"}
# URI schemes and the Hadoop file system that serves each.
SCHEMES = {"s3": "s3a", "s3a": "s3a", "gs": "gs", "file": "file", "hdfs": "hdfs", "abfss": "abfss", "dbfs": "dbfs"}
# Characters that may separate CSV fields; the first is assumed when none occurs.
SEPARATORS = (",", "|", ";", "\t")
# Quotes are doubled inside quoted fields, and spaces belong to the values.
CSV_DIALECT = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def detect_format(uri: str) -> str:
    """Format by the ending of ``uri``, in any case, without its query string."""
    path = uri.split("?")[0].rstrip("/").lower()
    for ending, fmt in FORMATS.items():
        if path.endswith(ending):
            return fmt
    raise ValueError(f"Unsupported file type: {uri!r} must end in one of {', '.join(FORMATS)}")


def resolve_uri(uri: str) -> str:
    """Check a URI and give it the scheme of the Hadoop file system; paths without scheme stay as they are."""
    uri = uri.strip()
    if not uri:
        raise ValueError("The URI is empty")
    if "://" not in uri:
        return uri
    scheme, rest = uri.split("://", 1)
    scheme = scheme.lower()
    if scheme in ("http", "https"):
        raise ValueError("Copy files served over HTTP to storage that all executors can reach, then read them there")
    if scheme not in SCHEMES:
        raise ValueError(f"Unsupported scheme {scheme!r}: use one of {', '.join(SCHEMES)}")
    return f"{SCHEMES[scheme]}://{rest}"


def read_source(
    spark: SparkSession,
    uri: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
    **options,
) -> DataFrame:
    """Read a table from ``uri``; the format follows from its ending unless given.

    With ``schema``, CSV and JSON are read in one distributed pass; without, types are inferred in a pass before. Inferred
    times are zone-less if written without an offset and moments (``timestamp``) if written with one. Rows that do not
    fit (too many or too few cells, values of another type, broken JSON) raise, unless ``mode`` says otherwise. Files
    whose records span lines (``multi_line``) cannot be split; if it is not given, a pass before finds out. So give it,
    and a schema and separator, for large inputs.
    """
    fmt = (fmt or detect_format(uri)).lower()
    path = resolve_uri(uri)
    if fmt == "parquet":
        reader = spark.read.options(**options)
        return (reader.schema(schema) if schema else reader).parquet(path)
    if fmt == "csv":
        return read_csv(spark, path, schema, multi_line, **options)
    if fmt == "json":
        return read_json(spark, path, schema, multi_line, **options)
    raise ValueError(f"Unsupported format {fmt!r}: use csv, parquet or json")


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
    sep: str | None = None,
    **options,
) -> DataFrame:
    """CSV with header. Inferred integers are widened to ``bigint``; see :func:`read_source` for times and bad rows.

    Without ``sep`` it is found from the first line of every file, and files that disagree are refused.
    """
    if sep is None:
        sep = _separator(_first_lines(spark, path))
    if multi_line is None:
        quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
        multi_line = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    given = {"header": True, "enforceSchema": False, "multiLine": multi_line, "sep": sep, "mode": "FAILFAST"}
    reader = spark.read.options(**(given | CSV_DIALECT | options))
    if schema:
        return reader.schema(schema).csv(path)
    with _zoneless(spark):
        found = reader.option("inferSchema", True).csv(path)
    return _canonical(found)


def _first_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file`` and ``line``: the first line of each file that is not blank. Tasks pass on one line per file."""
    # Row numbers grow within a task, and the tasks of a file start at different bytes of it.
    place = F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("nth"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", place.alias("place"))
    filled = lines.where(F.trim(F.translate("value", "\t\r", "  ")) != "")
    return filled.groupBy("file").agg(F.min_by("value", "place").alias("line"))


def _separator(first_lines: DataFrame) -> str:
    """The candidate that occurs most often, outside quotes, in the first line of a file; the same for all files."""
    unquoted = F.regexp_replace("line", '"[^"]*"', "")
    counts = [F.length(unquoted) - F.length(F.replace(unquoted, F.lit(c))) for c in SEPARATORS]
    most = F.greatest(*counts)
    best = F.coalesce(*[F.when(n == most, F.lit(c)) for c, n in zip(SEPARATORS, counts, strict=True)])
    # A header of one column fits any separator.
    found = {r.sep for r in first_lines.where(most > 0).select(best.alias("sep")).distinct().collect()}
    if len(found) > 1:
        raise ValueError(f"The files are separated differently, by {sorted(found)}; give sep, or read them apart")
    return found.pop() if found else SEPARATORS[0]


def read_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
    **options,
) -> DataFrame:
    """JSON objects, one or an array of them per line, or an array over many lines; see :func:`read_source`.

    Without ``multi_line``, each file is read by its own shape: by line if its first line is complete, else as one array.
    """
    options = {"mode": "FAILFAST"} | options
    if multi_line is not None:
        return _json(spark, path, schema, multi_line, options)
    text = F.trim(F.translate("line", "\t\r", "  "))
    begins, ends = F.substring(text, 1, 1), F.substring(text, -1, 1)
    whole = ((begins == "{") & (ends == "}")) | ((begins == "[") & (ends == "]"))
    shapes = _first_lines(spark, path).select("file", F.when(whole, "line").when(begins == "[", "array").alias("shape"))
    files: dict[str | None, list[str]] = {}
    for row in shapes.collect():
        files.setdefault(row["shape"], []).append(row.file)
    if None in files:
        raise ValueError(f"Objects over several lines, as in {files[None][0]}, need multi_line=True (one value per file)")
    if len(files) < 2:
        return _json(spark, path, schema, "array" in files, options)
    parts = [_json(spark, files[shape], schema, shape == "array", options) for shape in ("line", "array")]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def _json(spark: SparkSession, path: str | list[str], schema, multi_line: bool, options: dict) -> DataFrame:
    reader = spark.read.options(multiLine=multi_line, **options)
    if schema:
        return reader.schema(schema).json(path)
    with _zoneless(spark):
        found = reader.option("inferTimestamp", True).json(path)
    return _canonical(found)


@contextmanager
def _zoneless(spark: SparkSession) -> Iterator[None]:
    """While types are inferred, times without an offset are zone-less and those with one are moments."""
    name = "spark.sql.timestampType"
    before = spark.conf.get(name)
    spark.conf.set(name, "TIMESTAMP_NTZ")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _canonical(df: DataFrame) -> DataFrame:
    """The integer width that files without types are read with, so that schemas of two sides agree."""
    narrow = (T.ByteType, T.ShortType, T.IntegerType)

    def typed(field: T.StructField):
        column = F.col(quoted(field.name))
        return column.cast("bigint").alias(field.name) if isinstance(field.dataType, narrow) else column

    return df.select(*[typed(field) for field in df.schema])
