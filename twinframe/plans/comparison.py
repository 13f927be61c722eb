"""The comparison of two tables, put together from the operators."""

from __future__ import annotations

from contextlib import nullcontext
from functools import cached_property
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.config import DiffConfig
from twinframe.operators import drill, keys, paging, pairs, summary
from twinframe.operators.audit import ActivityLog, Outcome
from twinframe.operators.keys import HotKeys, KeyTotals
from twinframe.operators.schema import compare_schemas, quoted
from twinframe.operators.sides import prepare
from twinframe.session import stored
from twinframe.sources.export import export


class Comparison:
    """All answers about tables ``a`` and ``b`` under one configuration, as DataFrames.

    Creating it starts no job. The first answer counts keys once (:attr:`key_totals`); the counts tell how keys repeat
    and so how to compute the rest. :meth:`materialize` stores the diff join for many look-ups.
    """

    def __init__(self, a: DataFrame, b: DataFrame, config: DiffConfig, log: ActivityLog | None = None) -> None:
        self.config = config
        self.log = log
        self.a, self.b, self.layout = prepare(a, b, config)
        self._stored: DataFrame | None = None
        self._index: DataFrame | None = None
        self._statistics: DataFrame | None = None

    # Keys

    @cached_property
    def key_totals(self) -> KeyTotals:
        """Counts of rows, exclusive rows, duplicate and NULL keys, pairs and hot keys (a few rows, fetched once)."""
        profile = keys.key_profile(self.a, self.b, self.config, self._index).collect()
        totals = keys.key_totals(profile, self.config)
        if self.config.on_duplicates == "error" and (totals.duplicate_pks_a or totals.duplicate_pks_b):
            raise ValueError(
                f"Keys repeat: {totals.duplicate_pks_a} key values in A, {totals.duplicate_pks_b} in B"
            )
        return totals

    @cached_property
    def _hot(self) -> HotKeys | None:
        return keys.hot_keys(self.a, self.b, self.key_totals, self._index) if self.key_totals.hot_keys else None

    @cached_property
    def _hot_pairs(self) -> DataFrame:
        return pairs.hot_pairs(self.a, self.b, self.layout, self._hot)

    def schema(self) -> DataFrame:
        return compare_schemas(self.a.source, self.b.source)

    def only_in(self, side: str) -> DataFrame:
        """Rows of side ``a`` or ``b`` without partner, with the columns of that table."""
        one, other = self._sides(side)
        return keys.with_partner(one, other, self.key_totals, self._hot, "left_anti", self._index)

    def in_both(self, side: str) -> DataFrame:
        """Rows of side ``a`` or ``b`` with a partner, each once."""
        one, other = self._sides(side)
        return keys.with_partner(one, other, self.key_totals, self._hot, "left_semi", self._index)

    def duplicate_keys(self, side: str) -> DataFrame:
        """Repeated key values of a side with their ``count``."""
        return keys.duplicate_keys(self._sides(side)[0], self.config, self._index)

    def _sides(self, side: str):
        if side not in ("a", "b"):
            raise ValueError(f"Side must be 'a' or 'b', not {side!r}")
        return (self.a, self.b) if side == "a" else (self.b, self.a)

    # Statistics

    @cached_property
    def strategy(self) -> str:
        """How statistics are computed: from joined ``pairs``, from value ``groups``, or hot keys from groups (``split``)."""
        totals = self.key_totals
        rows = totals.total_rows_a + totals.total_rows_b
        budget = self.config.pair_budget * rows * (len(self.layout.compared) + 1)
        if totals.pairs <= budget:
            return "pairs"
        if totals.cold_pairs <= budget and self._hot is not None:
            return "split"
        return "groups"

    def stats(self) -> DataFrame:
        """One row with every count over matched pairs; :meth:`overview` and :meth:`column_stats` unfold it."""
        if self._statistics is not None:
            return self._statistics
        layout = self.layout
        if self._stored is not None:
            matched = drill.positional(self._stored.where("in_a and in_b"), layout)
            return summary.aggregate_flags(matched, layout)
        rows_a, rows_b = self.a.rows, self.b.rows
        if self.strategy == "pairs":
            return self._with_unchanged([summary.from_pairs(self._pairs(changed=True), layout)])
        hot = self._hot
        if hot is not None:
            hot_a = hot.hot(rows_a, layout.key("a")).select(*rows_a.columns)
            hot_b = hot.hot(rows_b, layout.key("b")).select(*rows_b.columns)
        if self.strategy == "groups":
            # Keys that are not hot are counted where their rows are, if there is a bound to how many they have.
            if self.key_totals.hot_from > pairs.FULL_OUTER_ROWS or not summary.can_count_by_keys(layout, rows_a.select(*layout.key("a"))):
                return summary.from_groups(rows_a, rows_b, layout)
            if hot is None:
                return summary.from_keys(rows_a, rows_b, layout)
            cold_a, cold_b = hot.cold(rows_a, layout.key("a")), hot.cold(rows_b, layout.key("b"))
            return summary.added([summary.from_keys(cold_a, cold_b, layout), summary.from_groups(hot_a, hot_b, layout)], layout)
        cold = pairs.cold_pairs(self.a, self.b, layout, hot, self._changed)
        return self._with_unchanged([summary.from_pairs(cold, layout), summary.from_groups(hot_a, hot_b, layout)])

    def _with_unchanged(self, parts: list[DataFrame]) -> DataFrame:
        """Add the pairs that the key index has left out of the join."""
        if self._index is not None:
            below = self.key_totals.hot_from if self._hot is not None else None
            parts = [*parts, summary.unchanged(self._index, keys.key_names(self.a), self.layout, below)]
        return summary.added(parts, self.layout)

    def run(self) -> Comparison:
        """Compute the statistics now, so that :meth:`overview` and :meth:`column_stats` share one pass over the data.

        What is kept is a single row of counts.
        """
        with self._logged("statistics") as outcome:
            stats = self.stats()
            row = stats.first()
            outcome.rows = row.pairs
        self._statistics = self.a.source.sparkSession.createDataFrame([row], stats.schema)
        return self

    def column_stats(self) -> DataFrame:
        """Differing, minor and matching cells of each compared column."""
        return summary.column_stats(self.stats(), self.layout)

    def ranked_columns(self) -> DataFrame:
        return summary.ranked(self.column_stats())

    def overview(self) -> DataFrame:
        """One row: sizes, exclusive rows, key problems, and matched rows by class."""
        totals = self.key_totals
        problems = totals
        if self.config.where_scope == "join" and self.config.row_filter:
            problems = SimpleNamespace(**keys.unfiltered_problem_counts(self.a, self.b).first().asDict())
        exclusive_a, exclusive_b, compared = totals.exclusive_a, totals.exclusive_b, F.col("pairs")
        identical = F.col("rows_identical")
        if self.config.null_keys == "both_sides":
            # A row with a wholly NULL key looks exclusive from both sides, and is taken off the compared rows twice.
            twice = totals.all_null_a + totals.all_null_b
            exclusive_a, exclusive_b = exclusive_a + totals.all_null_b, exclusive_b + totals.all_null_a
            compared, identical = compared - F.lit(twice), identical - F.lit(twice)

        def known(value: int, name: str) -> Column:
            return F.lit(int(value)).cast("long").alias(name)

        return self.stats().select(
            known(totals.total_rows_a, "total_rows_a"),
            known(totals.total_rows_b, "total_rows_b"),
            known(exclusive_a, "exclusive_a"),
            known(exclusive_b, "exclusive_b"),
            *[
                known(getattr(problems, name), name)
                for name in ("duplicate_pks_a", "duplicate_pks_b", "null_pks_a", "null_pks_b")
            ],
            compared.alias("total_compared"),
            "rows_with_diffs",
            "rows_minor",
            identical.alias("rows_identical"),
        )

    # Rows

    def _asked_for(self) -> None:
        """Rows of keys that repeat on both sides multiply, so they are given only where that was asked for."""
        if self.config.on_duplicates != "pairs" and self.key_totals.multiplied:
            raise ValueError(
                f"Keys that repeat in both tables make {self.key_totals.multiplied} pairs of rows; "
                "set on_duplicates='pairs' to get them all, or use the statistics, which count them"
            )

    @property
    def _changed(self) -> DataFrame | None:
        return None if self._index is None else keys.changed_keys(self._index)

    def _pairs(self, changed: bool = False) -> DataFrame:
        """Pairs of rows; with ``changed``, unchanged keys that are not hot may be missing."""
        cold = pairs.cold_pairs(self.a, self.b, self.layout, self._hot, self._changed if changed else None)
        return cold if self._hot is None else cold.unionByName(self._hot_pairs)

    def _flagged_pairs(self, changed: bool = False) -> DataFrame:
        if self._stored is not None:
            return drill.positional(self._stored.where("in_a and in_b"), self.layout)
        self._asked_for()
        return pairs.with_flags(self._pairs(changed), self.layout)

    def _flagged_join(self) -> DataFrame:
        self._asked_for()
        joined = pairs.cold_join(self.a, self.b, self.layout, self.key_totals, self._hot)
        if self._hot is not None:
            joined = joined.unionByName(pairs.hot_join(self.a, self.b, self.layout, self._hot, self._hot_pairs))
        return pairs.with_flags(joined, self.layout)

    def diff_join(self) -> DataFrame:
        """Matched pairs and rows without partner: keys, values and flags of both sides."""
        if self._stored is not None:
            return self._stored.drop(*pairs.PRESENT)
        return drill.flat(self._flagged_join(), self.layout)

    def rows(self, which: str = "diffs", column: str | None = None, flags: bool = True) -> DataFrame:
        """Matched rows of class ``all``, ``diffs``, ``minor`` or ``same``; ``column`` narrows ``diffs`` and ``minor``."""
        flagged = self._flagged_pairs(changed=which in ("diffs", "minor"))
        return drill.flat(drill.selected(flagged, self.layout, which, column), self.layout, flags)

    def _all_by_range(self, column: str | None) -> DataFrame:
        """All matched rows, in partitions that follow each other by key."""
        self._asked_for()
        flagged = pairs.with_flags(pairs.pairs_by_range(self.a, self.b, self.layout), self.layout)
        return drill.flat(drill.selected(flagged, self.layout, "all", column), self.layout)

    @property
    def order(self) -> list[str]:
        """The key columns of A in the flat result."""
        return [f"pk_{name}_a" for name in self.layout.keys]

    def page(self, which: str = "diffs", column: str | None = None, page: int = 0, page_size: int = 50) -> drill.Page:
        rows = self.rows(which, column)
        return drill.page_of(rows, drill.row_order(rows, self.order), page, page_size)

    def page_after(
        self, last: dict, which: str = "diffs", column: str | None = None, page_size: int = 50, seen: int = 1
    ) -> DataFrame:
        """The rows after the row ``last`` of a page; ``seen`` as in :func:`twinframe.operators.drill.page_after`."""
        rows = self.rows(which, column)
        return drill.page_after(rows, drill.row_order(rows, self.order), last, page_size, seen)

    def paged(
        self,
        which: str = "diffs",
        column: str | None = None,
        path: str | None = None,
        rows_per_file: int = paging.ROWS_PER_FILE,
    ) -> paging.PagedRows:
        """Store the rows of a class sorted by key, with an index of the files, so that any page is read by its number or key."""
        with self._logged("paged") as outcome:
            # All pairs are more than the rows they are made of, so these are put in order; chosen pairs are fewer as a rule.
            ranged = which == "all" and self._stored is None and self.key_totals.most_pairs <= pairs.ONE_TASK_PAIRS
            rows = self._all_by_range(column) if ranged else self.rows(which, column)
            found = paging.paged(rows, self.order, path, rows_per_file, ranged)
            outcome.rows = found.total
        return found

    def only_in_page(self, side: str, page: int = 0, page_size: int = 50) -> drill.Page:
        rows = self.only_in(side)
        if self.config.key_expression:
            order = [F.expr(self.config.key_expression), *drill.row_order(rows, [])]
            return drill.page_of(rows, order, page, page_size)
        return drill.page_of(rows, drill.row_order(rows, list(self.config.pk_columns)), page, page_size)

    def duplicate_keys_page(self, side: str, page: int = 0, page_size: int = 50) -> drill.Page:
        found = self.duplicate_keys(side)
        by_key = [F.col(quoted(name)) for name in found.columns if name != "count"]
        return drill.page_of(found, [F.col("count").desc(), *by_key], page, page_size)

    def cell_changes(self, minor: bool = True, display_precision: int | None = None) -> DataFrame:
        """One row per changed cell of matched rows."""
        return drill.cell_changes(self._flagged_pairs(changed=True), self.layout, minor, display_precision)

    def char_changes(self, minor: bool = True, display_precision: int | None = None) -> DataFrame:
        """Changed cells with their character-level parts on both sides."""
        return drill.with_char_diff(self.cell_changes(minor, display_precision))

    # Storage

    def indexed(self, path: str | None = None) -> Comparison:
        """Store one row per key (``path``, or the shared folder): its rows on each side, and whether any of them differ.

        All key questions are then answered from it without grouping the tables again, and statistics, differing rows and
        changed cells read and join the wide rows of changed keys only. Worth it for several questions about tables of
        mostly equal rows; a single one is cheaper without, as the index reads all compared columns once.
        """
        kept = Comparison(self.a.source, self.b.source, self.config, self.log)
        kept._stored = self._stored
        with self._logged("index"):
            kept._index = stored(keys.key_index(self.a, self.b, self.layout), "key-index", path)
        return kept

    def materialize(self, path: str | None = None, by_key: bool = False) -> Comparison:
        """Store the diff join as Parquet (``path``, or the shared folder) and answer row questions from it.

        Worth it for several look-ups; a single one is cheaper without, as it reads and shuffles only what it needs.
        With ``by_key`` the files are sorted by key, so that key ranges and keyset pages read a few of them only.
        """
        flat = drill.flat(self._flagged_join(), self.layout, extra=pairs.PRESENT)
        if by_key:
            order = [F.col(quoted(name)) for name in self.order]
            flat = flat.repartitionByRange(*order).sortWithinPartitions(*order)
        kept = Comparison(self.a.source, self.b.source, self.config, self.log)
        kept.__dict__["key_totals"] = self.key_totals
        kept._index = self._index
        with self._logged("materialize"):
            kept._stored = stored(flat, "diff-join", path)
        return kept

    def export(
        self, path: str, fmt: str | None = None, which: str = "diffs", column: str | None = None, **options
    ) -> int:
        """Write matched rows of a class, without flags and sorted by key, and return their number.

        Options are those of :func:`twinframe.sources.export.export`.
        """
        with self._logged("export") as outcome:
            outcome.rows = export(self.rows(which, column, flags=False), path, fmt, self.order, **options)
        return outcome.rows

    def _logged(self, operation: str):
        """Record an operation in the log, if there is one, with the key and row filter that define it."""
        key = self.config.key_expression or ", ".join(self.config.pk_columns)
        where = f" WHERE {self.config.row_filter}" if self.config.row_filter else ""
        return self.log.record(operation, f"KEY {key}{where}") if self.log else nullcontext(Outcome())


def compare(
    a: DataFrame, b: DataFrame, config: DiffConfig | None = None, log: ActivityLog | None = None, **settings
) -> Comparison:
    """Compare two tables; settings are those of :class:`twinframe.DiffConfig`. Operations go to ``log`` if given."""
    return Comparison(a, b, config or DiffConfig(**settings), log)
