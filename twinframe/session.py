"""Shared-storage helpers: where intermediate tables go so that losing an executor loses nothing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """A folder all executors can reach: ``spark.checkpoint.dir``, else ``spark.sql.warehouse.dir``, on any master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{_scratch.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """What the library stores inside the block, without a path of its own, goes when the block ends, also by an error.

    Results that are to stay must be written or fetched inside. Blocks may be nested.
    """
    folder = fresh_path(spark, "scratch")
    outer = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(outer)
        remove(spark, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on any file system that Spark can reach; one that is not there is no error."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to shared storage and read it back: computed once, lineage cut, loss-proof."""
    target = path or fresh_path(df.sparkSession, label)
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def recommended_settings(input_bytes: int, columns: int = 0) -> dict[str, str]:
    """Spark settings for a comparison of ``input_bytes`` of data with up to ``columns`` columns.

    Shuffle partitions of about 200 MB fit executor memory; adaptive execution merges those that turn out small and
    splits skewed ones, but cannot add more. Wide joins stay compiled if the field limit covers both sides.
    """
    partitions = max(200, -(-input_bytes // (200 * 1024 * 1024)))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "134217728",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.codegen.maxFields": str(max(100, 4 * columns + 20)),
    }
