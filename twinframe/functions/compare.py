"""Cell comparators as Column expressions.

A comparator decides whether two cells of a matched row differ. All but one compare a *form* of the cell
(truncated number, trimmed string …) with null-safe equality, so equal cells share one label, and matching pairs can be
*counted* by grouping, without building the pairs. ``Seconds`` is a distance on the microsecond axis.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.config import (
    CaseInsensitive,
    CaseInsensitiveWhitespace,
    Precision,
    Seconds,
    Tolerance,
    Whitespace,
)

# The Unicode space separators (category Zs), the characters a whitespace tolerance ignores.
SPACE_SEPARATORS = (
    "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_timestamp(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType))


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def truncated(value: Column, digits: int) -> Column:
    """``value`` as a double cut (not rounded) after ``digits`` decimals; what cannot be scaled stays as it is."""
    x = value.cast("double")
    try:
        scale = F.lit(10.0 ** abs(digits))
    except OverflowError:
        scale = F.lit(float("inf"))
    y = x * scale if digits >= 0 else x / scale
    whole = y - y % F.lit(1.0)
    cut = whole / scale if digits >= 0 else whole * scale
    finite = ~F.isnan(cut) & (F.abs(cut) < F.lit(float("inf")))
    return F.when(finite, cut).otherwise(x)


def displayed(value: Column, digits: int) -> Column:
    """``value`` truncated for display, with exactly ``digits`` decimals (``digits`` ≥ 0)."""
    return F.format_string(f"%.{digits}f", truncated(value, digits))


def trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(SPACE_SEPARATORS))


def epoch_micros(value: Column, dtype: T.DataType) -> Column:
    """Microseconds since 1970 of a timestamp; zone-less ones are read as they are, whatever the session zone."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value)
    clock = (F.hour(value) * 60 + F.minute(value)).cast("long") * 60_000_000
    seconds = (F.date_part(F.lit("SECOND"), value) * 1_000_000).cast("long")
    return F.unix_date(value.cast("date")).cast("long") * 86_400_000_000 + clock + seconds


# Longer than the span of all timestamps (years 1 to 9999), so a larger tolerance means the same.
WIDEST_REACH = 640_000_000_000_000_000


def tolerated_micros(tolerance: Seconds) -> int:
    return min(int(Decimal(str(tolerance.seconds)) * 1_000_000), WIDEST_REACH)


def _plain(dtype: T.DataType) -> bool:
    """Whether values of a type can be compared and grouped as they are."""
    if isinstance(dtype, T.ArrayType):
        return _plain(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_plain(field.dataType) for field in dtype)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def comparable(value: Column, dtype: T.DataType) -> Column:
    """A form of ``value`` that supports equality and grouping, at every depth.

    Maps become entry lists sorted by key. Variants become JSON text, whose objects list their keys in order.
    """
    if _plain(dtype):
        return value
    if isinstance(dtype, T.VariantType):
        return F.to_json(value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: comparable(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = [comparable(value.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(dtype)]
        return F.when(value.isNotNull(), F.struct(*fields))
    entries = F.transform(
        F.map_entries(value),
        lambda e: F.struct(
            comparable(e["key"], dtype.keyType).alias("key"), comparable(e["value"], dtype.valueType).alias("value")
        ),
    )
    return F.array_sort(entries)


@dataclass(frozen=True)
class Comparator:
    """How one column of type ``dtype`` is compared; ``tolerance`` None means exactly."""

    dtype: T.DataType
    tolerance: Tolerance | None = None

    @property
    def exact(self) -> bool:
        return self.tolerance is None

    @property
    def by_distance(self) -> bool:
        return isinstance(self.tolerance, Seconds)

    def form(self, value: Column) -> Column:
        match self.tolerance:
            case Precision(digits):
                return truncated(value, digits)
            case CaseInsensitive():
                return F.lower(value)
            case Whitespace():
                return trimmed(value)
            case CaseInsensitiveWhitespace():
                return F.lower(trimmed(value))
        return comparable(value, self.dtype)

    def comparable_raw(self, value: Column) -> Column:
        return comparable(value, self.dtype)

    def raw_differs(self, a: Column, b: Column) -> Column:
        return ~self.comparable_raw(a).eqNullSafe(self.comparable_raw(b))

    def differs(self, a: Column, b: Column) -> Column:
        """True where the cells differ beyond the tolerance; the tolerance is evaluated on unequal cells only."""
        raw = self.raw_differs(a, b)
        if self.exact:
            return raw
        if self.by_distance:
            apart = F.abs(self.position(a) - self.position(b))
            return raw & (a.isNull() | b.isNull() | (apart > tolerated_micros(self.tolerance)))
        return raw & ~self.form(a).eqNullSafe(self.form(b))

    def position(self, value: Column) -> Column:
        """Where a cell lies on the axis of a distance comparator; other cells as they are."""
        return epoch_micros(value, self.dtype) if self.by_distance else value


def resolve(dtype: T.DataType, tolerance: Tolerance | None, default_precision: int | None) -> Comparator:
    """Comparator of a column: its own tolerance, else the default precision for numbers, else exact.

    A tolerance that does not fit the type falls through to exact comparison.
    """
    if tolerance is None and default_precision is not None and is_numeric(dtype):
        tolerance = Precision(default_precision)
    fits = {
        Precision: is_numeric,
        Seconds: is_timestamp,
        CaseInsensitive: is_string,
        Whitespace: is_string,
        CaseInsensitiveWhitespace: is_string,
    }
    if tolerance is not None and not fits[type(tolerance)](dtype):
        tolerance = None
    return Comparator(dtype, tolerance)


def any_of(conditions: list[Column]) -> Column:
    """Disjunction; false when there is nothing to test."""
    return reduce(or_, conditions, F.lit(False)) if conditions else F.lit(False)
