"""Activity log: what ran, how long it took, how many rows, which error."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.functions.text import redacted

LOG_SCHEMA = "timestamp long, operation string, sql string, duration_ms long, rows_affected long, error string"


@dataclass
class Outcome:
    """What a logged block may report about itself."""

    rows: int | None = None


class ActivityLog:
    """Entries of one session, kept until written with :meth:`append_to`; secrets in ``sql`` are never shown."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._entries: list[tuple] = []

    @contextmanager
    def record(self, operation: str, sql: str = "") -> Iterator[Outcome]:
        """Log the enclosed block; an exception is logged and passed on."""
        started, outcome, error = time.time(), Outcome(), None
        try:
            yield outcome
        except Exception as raised:
            error = str(raised)
            raise
        finally:
            duration = int((time.time() - started) * 1000)
            self._entries.append((int(started * 1000), operation, sql, duration, outcome.rows, error))

    def entries(self) -> DataFrame:
        return show_log(self._spark.createDataFrame(self._entries, LOG_SCHEMA))

    def clear(self) -> None:
        self._entries.clear()

    def append_to(self, path: str) -> None:
        """Append the entries to the Parquet table at ``path`` and start afresh."""
        self.entries().coalesce(1).write.mode("append").parquet(path)
        self.clear()


def show_log(log: DataFrame) -> DataFrame:
    """A log with secrets replaced in its statements and errors."""
    return log.withColumns({"sql": redacted(F.col("sql")), "error": redacted(F.col("error"))})
