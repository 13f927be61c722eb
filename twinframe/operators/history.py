"""Histories: upsert by grouping, retention by ranking, insertion of new names only; as frames, and as stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinframe.config import DiffConfig
from twinframe.functions.text import stripped
from twinframe.operators.versions import VersionedTable
from twinframe.plans.comparison import Comparison

# How many entries a history keeps per connection and in all.
KEPT_PER_CONNECTION = 50
KEPT_IN_TOTAL = 500


def upserted(log: DataFrame) -> DataFrame:
    """Fold a log of ``connection_id, query, used_at`` into one entry per query and connection.

    White space around a query does not matter and blank queries are left out. The first use is kept as ``created_at``,
    the latest as ``last_used_at``; ``id`` is derived from both keys, so it is the same in every run.
    """
    entry = log.select("connection_id", stripped(F.col("query")).alias("query"), "used_at").where("query <> ''")
    folded = entry.groupBy("connection_id", "query").agg(
        F.min("used_at").alias("created_at"), F.max("used_at").alias("last_used_at")
    )
    identity = F.sha2(F.to_json(F.struct("connection_id", "query"), {"ignoreNullFields": "false"}), 256)
    return folded.select(identity.alias("id"), "connection_id", "query", "created_at", "last_used_at")


def merged(history: DataFrame, log: DataFrame) -> DataFrame:
    """A history with the uses of a log: known queries keep their first use, and take a later last one."""
    both = history.unionByName(upserted(log))
    keys = ("id", "connection_id", "query")
    return both.groupBy(*keys).agg(F.min("created_at").alias("created_at"), F.max("last_used_at").alias("last_used_at"))


def newest_per_group(df: DataFrame, group: str, order: list[Column], n: int = KEPT_PER_CONNECTION) -> DataFrame:
    """The first ``n`` rows of each group under ``order``; NULL is a group. Each task passes on at most n per group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("rank_in_group", rank).where(F.col("rank_in_group") <= n).drop("rank_in_group")


def newest(df: DataFrame, order: list[Column], n: int = KEPT_IN_TOTAL) -> DataFrame:
    """The first ``n`` rows under ``order``. Each task passes on at most n."""
    return df.orderBy(*order).limit(n)


def retained(
    history: DataFrame, per_connection: int | None = KEPT_PER_CONNECTION, in_total: int | None = KEPT_IN_TOTAL
) -> DataFrame:
    """A history cut to its newest entries per connection and in all; None is no limit."""
    order = [F.col("last_used_at").desc(), F.col("id")]
    if per_connection is not None:
        history = newest_per_group(history, "connection_id", order, per_connection)
    return history if in_total is None else newest(history, order, in_total)


def read_history(history: DataFrame, connection_id: str | None = None) -> DataFrame:
    """Entries of one connection, or all, newest first."""
    found = history if connection_id is None else history.where(F.col("connection_id") == connection_id)
    return found.orderBy(F.col("last_used_at").desc(), "id")


def without_entry(history: DataFrame, entry_id: str) -> DataFrame:
    return history.where(F.col("id") != entry_id)


def cleared(history: DataFrame, connection_id: str | None = None) -> DataFrame:
    """The history without one connection's entries, or empty."""
    if connection_id is None:
        return history.where(F.lit(False))
    return history.where(~F.col("connection_id").eqNullSafe(connection_id))


def insert_new(existing: DataFrame, incoming: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """``existing`` plus the incoming rows whose ``on`` it lacks, and the incoming rows left out.

    Only names already in ``existing`` are left out; repeated new names are all inserted.
    """
    names = Comparison(incoming, existing, DiffConfig(pk_columns=[on]))
    return existing.unionByName(names.only_in("a"), allowMissingColumns=True), names.in_both("a")


class StoredHistory:
    """A history kept at ``path``; every change is a new version, so that a failure leaves the entries as they were."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        per_connection: int | None = KEPT_PER_CONNECTION,
        in_total: int | None = KEPT_IN_TOTAL,
    ) -> None:
        self.table = VersionedTable(spark, path)
        self._limits = per_connection, in_total

    def add(self, log: DataFrame) -> int:
        """Enter the uses of a log (``connection_id, query, used_at``), cut to the limits, and return the number of entries."""
        entries = merged(self.table.read(), log) if self.table.version else upserted(log)
        return self.table.replace(retained(entries, *self._limits))

    def read(self, connection_id: str | None = None) -> DataFrame:
        return read_history(self.table.read(), connection_id)

    def delete(self, entry_id: str) -> int:
        return self.table.change(lambda entries: without_entry(entries, entry_id))

    def clear(self, connection_id: str | None = None) -> int:
        return self.table.change(lambda entries: cleared(entries, connection_id))


def insert_new_into(table: VersionedTable, incoming: DataFrame, on: str) -> DataFrame:
    """:func:`insert_new` into a stored table; returns the incoming rows left out, told from the version before."""
    combined, skipped = insert_new(table.read(), incoming, on)
    table.replace(combined)
    return skipped
