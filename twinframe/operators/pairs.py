"""The diff join: pairs of rows with equal keys, optionally with the rows that have no partner.

Joining is done on the positional columns of :mod:`twinframe.operators.sides`. Three kinds of rows are kept out of the
plain join: rows with a NULL key part (they match nothing, and would all meet in one task), hot keys without partner
(known from the hot-key table) and hot keys with partner (split into a grid of parts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.functions.compare import any_of
from twinframe.operators.keys import HotKeys, KeyTotals
from twinframe.operators.sides import Layout, Side, has_null
from twinframe.session import stored

PRESENT = ("in_a", "in_b")
# Most rows of one key and side that a full outer join is trusted with. Hot keys never get there: the line decides, which
# all keys outside the complete hot-key table are below.
FULL_OUTER_ROWS = 100_000
# Most pairs of one key that are sorted within one task; where a key has more, a sort of all pairs spreads them.
ONE_TASK_PAIRS = 250_000


def cold_pairs(
    a: Side, b: Side, layout: Layout, hot: HotKeys | None, changed: DataFrame | None = None
) -> DataFrame:
    """All pairs of rows with equal keys, those of hot keys left out; of the keys ``changed`` only, if given.

    Rows of other keys are left before the join, and before its shuffle where Spark broadcasts the keys or sends a Bloom
    filter of them ahead.
    """
    rows_a, rows_b = a.rows, b.rows
    if hot is not None:
        rows_a, rows_b = hot.cold(rows_a, layout.key("a")), hot.cold(rows_b, layout.key("b"))
    if changed is not None:
        rows_a, rows_b = (
            rows.join(changed, [F.col(x) == F.col(y) for x, y in zip(keys, changed.columns, strict=True)], "left_semi")
            for rows, keys in ((rows_a, layout.key("a")), (rows_b, layout.key("b")))
        )
    return rows_a.join(rows_b, _equal(layout), "inner")


def hot_pairs(a: Side, b: Side, layout: Layout, hot: HotKeys) -> DataFrame:
    """Pairs of hot keys by a grid: rows of A take a line, rows of B a column, and each copy meets in one cell.

    A row's place follows from its position in its task. The rows are stored first, so that a task run again reads them
    in the same order and places them alike.
    """
    partnered = (F.col("in_a") > 0) & (F.col("in_b") > 0)
    rows = {}
    for side, own, other in ((a, "parts_a", "parts_b"), (b, "parts_b", "parts_a")):
        kept = _hot_rows(side, layout, hot, partnered).select(*layout.all(side.name), own, other)
        rows[side.name] = (
            stored(kept, f"hot-rows-{side.name}")
            .withColumn(f"{side.name}_own", F.pmod(F.monotonically_increasing_id(), F.col(own)).cast("int"))
            .withColumn(f"{side.name}_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .drop(own, other)
        )
    cell = [F.col("a_own") == F.col("b_other"), F.col("a_other") == F.col("b_own")]
    joined = rows["a"].join(rows["b"], [*_equal(layout), *cell], "inner")
    return joined.select(*layout.all("a"), *layout.all("b"))


def pairs_by_range(a: Side, b: Side, layout: Layout) -> DataFrame:
    """All pairs of rows with equal keys, in partitions that follow each other by key; a key's pairs are in one.

    The rows of both sides are shuffled together, by ranges of the key, and paired where they are. A global sort of the
    pairs would shuffle these once more, though they are twice as wide and may be many more. Finding the ranges reads the
    sources once more.
    """
    names = [f"k{i}" for i in range(len(layout.keys))]
    rows = {side.name: F.struct(*layout.all(side.name)) for side in (a, b)}
    kinds = {side.name: side.rows.select(rows[side.name].alias("row")).schema["row"].dataType for side in (a, b)}
    tagged = []
    for side in (a, b):
        own = layout.key(side.name)
        columns = [(rows[x] if x == side.name else F.lit(None).cast(kinds[x])).alias(x) for x in "ab"]
        keys = [F.col(x).alias(y) for x, y in zip(own, names, strict=True)]
        tagged.append(side.rows.where(~has_null(own)).select(*keys, *columns))
    by_key = tagged[0].unionAll(tagged[1]).repartitionByRange(*names).groupBy(*names)
    grouped = by_key.agg(F.collect_list("a").alias("rows_a"), F.collect_list("b").alias("rows_b"))
    paired = grouped.select(F.explode("rows_a").alias("a"), "rows_b").select("a", F.explode("rows_b").alias("b"))
    return paired.select(*[F.col(f"{x}.{name}") for x in "ab" for name in layout.all(x)])


def cold_join(a: Side, b: Side, layout: Layout, totals: KeyTotals, hot: HotKeys | None) -> DataFrame:
    """Pairs and rows without partner of all keys that are not hot, with presence flags ``in_a`` and ``in_b``."""
    rows_a, rows_b = a.rows, b.rows
    alone = []
    if totals.null_pks_a:
        alone.append(_alone(rows_a.where(has_null(layout.key("a"))), "a"))
        rows_a = rows_a.where(~has_null(layout.key("a")))
    if totals.null_pks_b:
        alone.append(_alone(rows_b.where(has_null(layout.key("b"))), "b"))
        rows_b = rows_b.where(~has_null(layout.key("b")))
    if hot is not None:
        rows_a, rows_b = hot.cold(rows_a, layout.key("a")), hot.cold(rows_b, layout.key("b"))
    if totals.hot_from <= FULL_OUTER_ROWS:
        joined = (
            rows_a.withColumn("in_a", F.lit(True))
            .join(rows_b.withColumn("in_b", F.lit(True)), _equal(layout), "full_outer")
            .withColumns({flag: F.coalesce(F.col(flag), F.lit(False)) for flag in PRESENT})
        )
    else:
        # A full outer join holds all rows of a key in memory; an outer join of one side and the rest of the other do not.
        joined = rows_a.join(rows_b.withColumn("in_b", F.lit(True)), _equal(layout), "left_outer").withColumns(
            {"in_a": F.lit(True), "in_b": F.coalesce(F.col("in_b"), F.lit(False))}
        )
        alone.append(_alone(rows_b.join(rows_a.select(*layout.key("a")), _equal(layout), "left_anti"), "b"))
    return _united([joined, *alone], layout)


def hot_join(a: Side, b: Side, layout: Layout, hot: HotKeys, paired: DataFrame) -> DataFrame:
    """The same for hot keys, whose pairs are given."""
    parts = [
        paired.withColumns({flag: F.lit(True) for flag in PRESENT}),
        _alone(_hot_rows(a, layout, hot, F.col("in_b") == 0).select(*layout.all("a")), "a"),
        _alone(_hot_rows(b, layout, hot, F.col("in_a") == 0).select(*layout.all("b")), "b"),
    ]
    return _united(parts, layout)


def _united(parts: list[DataFrame], layout: Layout) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result.select(*layout.all("a"), *layout.all("b"), *PRESENT)


def with_flags(pairs: DataFrame, layout: Layout) -> DataFrame:
    """Add the boolean flags ``d<i>`` (differs beyond tolerance) and ``r<i>`` (differs at all)."""
    flags = {}
    for i, comparator in enumerate(layout.comparators):
        a, b = F.col(f"av{i}"), F.col(f"bv{i}")
        flags[f"d{i}"] = comparator.differs(a, b)
        flags[f"r{i}"] = comparator.raw_differs(a, b)
    return pairs.withColumns(flags) if flags else pairs


def row_class(layout: Layout) -> Column:
    """``diffs`` | ``minor`` | ``same`` of a matched, flagged row."""
    return (
        F.when(any_of([F.col(flag) for flag in layout.flags]), "diffs")
        .when(any_of([F.col(flag) for flag in layout.raw_flags]), "minor")
        .otherwise("same")
    )


def _equal(layout: Layout) -> list[Column]:
    return [F.col(x) == F.col(y) for x, y in zip(layout.key("a"), layout.key("b"), strict=True)]


def _alone(rows: DataFrame, side: str) -> DataFrame:
    return rows.withColumns({flag: F.lit(flag == f"in_{side}") for flag in PRESENT})


def _hot_rows(side: Side, layout: Layout, hot: HotKeys, which: Column) -> DataFrame:
    return hot.hot(side.rows, layout.key(side.name)).where(which)
