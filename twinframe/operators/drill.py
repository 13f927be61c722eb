"""From the diff join to what a reader looks at: row classes, flat result, pages, changed cells."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.functions.chars import char_diff
from twinframe.functions.compare import displayed, is_numeric
from twinframe.operators.pairs import row_class
from twinframe.operators.schema import quoted
from twinframe.operators.sides import Layout

ROW_CLASSES = ("all", "diffs", "minor", "same")


def selected(flagged: DataFrame, layout: Layout, which: str = "diffs", column: str | None = None) -> DataFrame:
    """Matched rows of a class; with ``column``, ``diffs`` and ``minor`` look at that column alone."""
    if which not in ROW_CLASSES:
        raise ValueError(f"Row class must be one of {', '.join(ROW_CLASSES)}, not {which!r}")
    if column is not None and column not in layout.compared:
        raise ValueError(f"Column {column!r} is not compared")
    if which == "all":
        return flagged
    if column is not None and which in ("diffs", "minor"):
        i = layout.compared.index(column)
        differs, raw = F.col(f"d{i}"), F.col(f"r{i}")
        return flagged.where(differs if which == "diffs" else raw & ~differs)
    return flagged.where(row_class(layout) == which)


def flat(flagged: DataFrame, layout: Layout, flags: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    """Public column names: key and value pairs in order, then all ``is_diff_*``, then all ``is_raw_diff_*`` (0/1)."""
    columns = [F.col(internal).alias(public) for internal, public in layout.value_names()]
    if flags:
        columns += [F.col(internal).cast("int").alias(public) for internal, public in layout.flag_names()]
    return flagged.select(*columns, *extra)


def positional(flat_rows: DataFrame, layout: Layout) -> DataFrame:
    """The inverse of :func:`flat`."""
    columns = [F.col(quoted(public)).alias(internal) for internal, public in layout.value_names()]
    columns += [(F.col(quoted(public)) == 1).alias(internal) for internal, public in layout.flag_names()]
    return flat_rows.select(*columns)


def row_order(df: DataFrame, first: list[str]) -> list[str]:
    """``first``, then every other sortable column, so that equal keys have a fixed order."""
    rest = [field.name for field in df.schema if field.name not in first and _sortable(field.dataType)]
    return [*first, *rest]


def _sortable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _sortable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_sortable(field.dataType) for field in dtype)
    return not isinstance(dtype, (T.MapType, T.VariantType))


@dataclass(frozen=True)
class Page:
    """One page of ``source`` in a fixed order; ``total`` counts the whole of it when asked."""

    source: DataFrame
    rows: DataFrame
    page: int
    page_size: int
    counted: int | None = None

    @property
    def columns(self) -> list[str]:
        return self.rows.columns

    @property
    def total(self) -> int:
        return self.source.count() if self.counted is None else self.counted

    def json(self) -> DataFrame:
        """The rows as JSON objects, NULLs included."""
        return self.rows.select(
            F.to_json(F.struct(*[F.col(quoted(c)) for c in self.columns]), {"ignoreNullFields": "false"}).alias("row")
        )


def page_of(df: DataFrame, order: list[Column | str], page: int = 0, page_size: int = 50) -> Page:
    """Page ``page`` (from 0) under ``order``, of any size.

    Spark keeps the best page·size rows per task, so this suits the first pages. Use :func:`page_after` to walk on, or
    :func:`twinframe.operators.paging.paged` for pages anywhere.
    """
    if page < 0 or page_size < 1:
        raise ValueError("page must not be negative and page_size must be positive")
    columns = [F.col(quoted(c)) if isinstance(c, str) else c for c in order]
    return Page(df, df.orderBy(*columns).offset(page * page_size).limit(page_size), page, page_size)


def page_after(df: DataFrame, order: list[str], last: dict[str, Any], page_size: int = 50, seen: int = 1) -> DataFrame:
    """The page following the row ``last`` (its values of ``order``): a filter instead of an offset, at any depth.

    ``order`` must be total: it has every sortable column, as :func:`row_order` gives it. Rows equal in all of them follow
    each other; ``seen`` says how many equal to ``last`` earlier pages ended with.
    """
    missing = set(row_order(df, order)) - set(order)
    if missing:
        raise ValueError(f"The order is not total: rows may tie, as it lacks {', '.join(sorted(missing))}")
    if seen < 1 or page_size < 1:
        raise ValueError("seen and page_size must be positive")
    types = {field.name: field.dataType for field in df.schema}
    values = {name: F.lit(last[name]).cast(types[name]) for name in order}
    later = []
    for i, name in enumerate(order):
        value = F.col(quoted(name))
        # NULLs come first in ascending order.
        beyond = value.isNotNull() if last[name] is None else value > values[name]
        ties = [F.col(quoted(tied)).eqNullSafe(values[tied]) for tied in order[:i]]
        later.append(reduce(and_, [*ties, beyond]))
    equal = reduce(and_, [F.col(quoted(name)).eqNullSafe(values[name]) for name in order])
    ordered = df.where(reduce(or_, later, equal)).orderBy(*[F.col(quoted(name)) for name in order])
    return ordered.offset(seen).limit(page_size)


CELL_CHANGE = "column:string,a:string,b:string,class:string"


def cell_changes(
    flagged: DataFrame, layout: Layout, minor: bool = True, display_precision: int | None = None
) -> DataFrame:
    """Long form, one row per changed cell: the key of A, ``column``, both values as text, ``diff`` or ``minor``.

    With ``display_precision``, numbers with a fraction are shown truncated to that many decimals.
    """
    cells = []
    for i, (name, comparator) in enumerate(zip(layout.compared, layout.comparators, strict=True)):

        def shown(value: Column, numeric: bool = is_numeric(comparator.dtype)) -> Column:
            if display_precision is None or not numeric:
                return value.cast("string")
            return F.when(value % 1 != 0, displayed(value, display_precision)).otherwise(value.cast("string"))

        kind = F.when(F.col(f"d{i}"), "diff")
        if minor:
            kind = kind.when(F.col(f"r{i}"), "minor")
        cells.append(
            F.struct(
                F.lit(name).alias("column"),
                shown(F.col(f"av{i}")).alias("a"),
                shown(F.col(f"bv{i}")).alias("b"),
                kind.alias("class"),
            )
        )
    keys = [F.col(f"ak{i}").alias(f"pk_{name}") for i, name in enumerate(layout.keys)]
    # The cells of a row are filtered as an array: a filter on rows would be copied once per column while it is planned.
    listed = F.filter(F.array(*cells).cast(f"array<struct<{CELL_CHANGE}>>"), lambda cell: cell["class"].isNotNull())
    return flagged.select(*keys, F.inline(listed))


def with_char_diff(changes: DataFrame) -> DataFrame:
    """Add ``parts_a`` and ``parts_b`` (see :mod:`twinframe.functions.chars`) to changed cells; NULL reads ``NULL``."""
    a, b = (F.coalesce(F.col(side), F.lit("NULL")) for side in ("a", "b"))
    parts = char_diff(a, b)
    return changes.withColumn("parts", parts).withColumns(
        {
            "parts_a": F.filter("parts", lambda part: part["kind"] != "added"),
            "parts_b": F.filter("parts", lambda part: part["kind"] != "removed"),
        }
    ).drop("parts")
