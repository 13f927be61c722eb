"""Stored tables that are replaced as a whole: a failure at any point leaves the version that was there."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.session import remove

COMMIT = "version bigint, folder string, rows bigint, schema string, at timestamp"


class VersionedTable:
    """A table at ``path``: each version is a folder under ``data``, made current by one row under ``commits``.

    The row is written after the folder is complete, and appears by the rename of a single file, so readers see the old
    version or the new one. Readers keep the version they began with. One writer at a time: of two that replace the same
    version, the later one stands.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path.rstrip("/")

    def versions(self) -> DataFrame:
        """``version``, ``folder``, ``rows``, ``schema`` and ``at`` of every version, none for a table not written yet."""
        try:
            return self._spark.read.schema(COMMIT).parquet(f"{self._path}/commits")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self._spark.createDataFrame([], COMMIT)

    def _newest(self, version: int | None = None):
        found = self.versions() if version is None else self.versions().where(F.col("version") == version)
        return found.agg(F.max_by(F.struct("*"), F.struct("version", "at", "folder"))).first()[0]

    @property
    def version(self) -> int:
        """The number of the current version, 0 before the first."""
        newest = self._newest()
        return newest.version if newest else 0

    def read(self, version: int | None = None) -> DataFrame:
        """The current version, or an earlier one."""
        commit = self._newest(version)
        if commit is None:
            raise ValueError(f"There is no version {version if version is not None else ''} of the table at {self._path}")
        schema = T.StructType.fromJson(json.loads(commit.schema))
        return self._spark.read.schema(schema).parquet(f"{self._path}/data/{commit.folder}")

    def replace(self, rows: DataFrame) -> int:
        """Make ``rows``, which may be read from this table, its next version, and return the number of rows."""
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self._path}/data/{folder}")
        count = self._spark.read.schema(rows.schema).parquet(f"{self._path}/data/{folder}").count()
        self._commit(folder, count, rows.schema)
        return count

    def _commit(self, folder: str, rows: int, schema: T.StructType) -> None:
        named = "version bigint, folder string, rows bigint, schema string"
        row = self._spark.createDataFrame([(self.version + 1, folder, rows, schema.json())], named)
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self._path}/commits")

    def change(self, step: Callable[[DataFrame], DataFrame]) -> int:
        """Replace the current version by what ``step`` makes of it."""
        return self.replace(step(self.read()))

    def vacuum(self, keep: int = 1) -> int:
        """Delete the rows of all versions but the newest ``keep``, and return how many versions went; their commits stay."""
        if keep < 1:
            raise ValueError("keep must be positive")
        old = self.versions().where(F.col("version") <= self.version - keep).select("folder").collect()
        for commit in old:
            remove(self._spark, f"{self._path}/data/{commit.folder}")
        return len(old)
