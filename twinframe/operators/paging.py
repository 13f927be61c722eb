"""Pages of large results by number: rows are stored once in order, and an index of the files leads to those of a page.

A page then reads the files that hold it, one or two as a rule, however far back it is.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.operators.drill import Page, row_order
from twinframe.operators.schema import quoted
from twinframe.session import fresh_path, stored

#: Rows of a file at most, which a page reads in the worst case besides its own.
ROWS_PER_FILE = 250_000
#: Tasks whose files are summed up in one group, so that the running count of all files is no single group.
STRETCH = 1024


class PagedRows:
    """Rows in a fixed order at ``path``: ``rows`` in files that are sorted and follow each other, and their index ``files``."""

    def __init__(self, spark: SparkSession, path: str, order: list[str], schema: T.StructType) -> None:
        self._spark, self._path, self._order, self._schema = spark, path, order, schema
        self.files = spark.read.parquet(f"{path}/files")

    @property
    def rows(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(f"{self._path}/rows")

    @property
    def total(self) -> int:
        """The number of all rows, from the index."""
        return self.files.agg(F.max(F.col("start") + F.col("rows"))).first()[0] or 0

    def page(self, page: int = 0, page_size: int = 50) -> Page:
        """Page ``page`` (from 0), empty beyond the last row."""
        if page < 0 or page_size < 1:
            raise ValueError("page must not be negative and page_size must be positive")
        first, end = page * page_size, (page + 1) * page_size
        # No file is empty, so no more are found than a page has rows.
        holding = self.files.where((F.col("start") < end) & (F.col("start") + F.col("rows") > first)).collect()
        rows = self._between(holding, first, end) if holding else self.rows.limit(0)
        return Page(self.rows, rows, page, page_size, self.total)

    def _between(self, files: list, first: int, end: int) -> DataFrame:
        read = self._spark.read.schema(self._schema).parquet(*[f"{self._path}/rows/{f.file}" for f in files])
        place = read.metadataColumn("_metadata")
        starts = F.create_map(*[F.lit(x) for f in files for x in (f.file, f.start)])
        numbered = read.select(F.struct("*").alias("row"), (starts[place["file_name"]] + place["row_index"]).alias("nth"))
        return numbered.where((F.col("nth") >= first) & (F.col("nth") < end)).orderBy("nth").select("row.*")

    def page_number(self, key: dict[str, Any], page_size: int = 50) -> int:
        """The page with the first row whose order columns are not below ``key``; if all are below, the page after the last row."""
        types = {field.name: field.dataType for field in self._schema}
        wanted = F.struct(*[F.lit(key[name]).cast(types[name]).alias(name) for name in self._order])
        # All files before the last one that begins below the key end below it.
        last = self.files.where(F.col("first") < wanted).orderBy(F.col("start").desc()).first()
        if last is None:
            return 0
        read = self._spark.read.schema(self._schema).parquet(f"{self._path}/rows/{last.file}")
        below = read.where(F.struct(*[F.col(quoted(name)).alias(name) for name in self._order]) < wanted).count()
        return (last.start + below) // page_size

    def page_at(self, key: dict[str, Any], page_size: int = 50) -> Page:
        """The page that :meth:`page_number` names."""
        return self.page(self.page_number(key, page_size), page_size)


def paged(
    df: DataFrame, order: list[str], path: str | None = None, rows_per_file: int = ROWS_PER_FILE, ranged: bool = False
) -> PagedRows:
    """Store ``df`` sorted by ``order`` and then by every other sortable column, at ``path`` or in the shared folder.

    Sorting is a range partitioning, and what is counted of the files is summed up in stretches, so nothing passes through
    one task. NULLs come first. Rows equal in all columns may stand in several files. With ``ranged`` the partitions of
    ``df`` follow each other by ``order`` already, rows equal in it stand in one, and they are sorted where they are.
    """
    spark, root = df.sparkSession, path or fresh_path(df.sparkSession, "pages")
    by = [F.col(quoted(name)) for name in row_order(df, order)]
    (df.sortWithinPartitions(*by) if ranged else df.orderBy(*by)).write.option("maxRecordsPerFile", rows_per_file).parquet(f"{root}/rows")
    rows = spark.read.schema(df.schema).parquet(f"{root}/rows")
    place = rows.metadataColumn("_metadata")
    key = F.struct(*[F.col(quoted(name)).alias(name) for name in order])
    # Spark names a file by the task that wrote it, tasks follow the order of rows, and by its number within the task.
    task, nth = (F.regexp_extract("file", r"^part-(\d+)-.*-c(\d+)", i).cast("int") for i in (1, 2))
    firsts = rows.where(place["row_index"] == 0).select(place["file_name"].alias("file"), key.alias("first"))
    # Every file is opened once, and what is known of it kept; only the last one of a task is counted, as the others are full.
    # They are shuffled, as each task of the scan would else write a small file of its own.
    files = stored(firsts.withColumns({"task": task, "nth": nth}).repartition("file"), "files", f"{root}/listed")
    last = files.groupBy("task").agg(F.max_by("file", "nth").alias("file")).select("file")
    names = [f"{root}/rows/{row.file}" for row in last.collect()]
    partly = spark.read.schema(df.schema).parquet(*names) if names else rows
    held = partly.select(partly.metadataColumn("_metadata")["file_name"].alias("file")).groupBy("file").agg(F.count("*").alias("held"))
    counted = {"rows": F.coalesce("held", F.lit(rows_per_file).cast("bigint")), "stretch": F.floor(F.col("task") / STRETCH)}
    files = stored(files.join(held, "file", "left").withColumns(counted), "files", f"{root}/counted")
    earlier = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = files.groupBy("stretch").agg(F.sum("rows").alias("n")).select("stretch", F.sum("n").over(earlier).alias("before"))
    within = Window.partitionBy("stretch").orderBy("task", "nth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce("before", F.lit(0)) + F.coalesce(F.sum("rows").over(within), F.lit(0))
    stored(files.join(before, "stretch").select("file", start.alias("start"), "rows", "first"), "files", f"{root}/files")
    return PagedRows(spark, root, order, df.schema)
