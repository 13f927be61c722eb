"""What to compare and how: key, tolerances, ignored columns, row filter."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Precision:
    """Numbers are equal when they agree after truncation to ``digits`` decimals (negative: tens, hundreds …)."""

    digits: int


@dataclass(frozen=True)
class Seconds:
    """Timestamps are equal when they are at most ``seconds`` apart (bound included)."""

    seconds: float


@dataclass(frozen=True)
class CaseInsensitive:
    """Strings are equal when their lower-case forms are."""


@dataclass(frozen=True)
class Whitespace:
    """Strings are equal when they agree after removing space characters at both ends."""


@dataclass(frozen=True)
class CaseInsensitiveWhitespace:
    """Both of the above."""


Tolerance = Precision | Seconds | CaseInsensitive | Whitespace | CaseInsensitiveWhitespace


def tolerance_from_dict(spec: Mapping[str, Any]) -> Tolerance:
    """Read a tolerance written as ``{"mode": …}``, the form used in stored configurations."""
    mode = spec.get("mode")
    if mode == "precision":
        return Precision(int(spec["precision"]))
    if mode == "seconds":
        return Seconds(float(spec["seconds"]))
    if mode == "case_insensitive":
        return CaseInsensitive()
    if mode == "whitespace":
        return Whitespace()
    if mode == "case_insensitive_whitespace":
        return CaseInsensitiveWhitespace()
    raise ValueError(f"Unknown tolerance mode: {mode!r}")


TYPE_MISMATCH_MODES = ("coerce", "string", "skip", "error")


@dataclass(frozen=True)
class DiffConfig:
    """Settings of one comparison.

    The key is either ``pk_columns`` (present in both tables) or ``pk_expression`` (a SQL expression over both).
    ``tolerance`` is a default precision for numeric columns; ``column_tolerances`` wins over it.

    ``on_type_mismatch`` decides on shared columns of different types: ``coerce`` uses Spark's common type,
    ``string`` compares their string forms, ``skip`` leaves them out, ``error`` refuses.
    ``on_duplicates``: statistics count all pairs of rows with equal keys, whatever it says. Rows of keys that repeat in
    both tables multiply, so row results raise if there are any (``count``), unless ``pairs`` asks for all of them;
    ``error`` refuses tables with repeated keys altogether.
    ``where_scope="join"`` counts duplicate and NULL keys before the row filter instead of after it.
    ``null_keys="both_sides"`` counts a row whose whole key is NULL as exclusive on both sides.

    ``hot_key_rows`` is the number of rows on one side from which a key is treated as hot; it is raised as far as needed
    to have at most ``max_hot_keys`` such keys, which are broadcast. ``pair_budget`` is the number of joined pairs, per input row and compared column, above
    which statistics are counted from grouped values instead of joined pairs.
    """

    pk_columns: Sequence[str] = ()
    pk_expression: str | None = None
    tolerance: int | None = None
    column_tolerances: Mapping[str, Tolerance] = field(default_factory=dict)
    ignored_columns: Sequence[str] = ()
    where_clause: str | None = None
    on_type_mismatch: str = "coerce"
    on_duplicates: str = "count"
    where_scope: str = "all"
    null_keys: str = "once"
    hot_key_rows: int = 100_000
    max_hot_keys: int = 20_000
    pair_budget: float = 1.0

    def __post_init__(self) -> None:
        if self.key_expression and self.pk_columns:
            raise ValueError("Give either pk_columns or pk_expression, not both")
        if not self.key_expression and not self.pk_columns:
            raise ValueError("A key is required: pk_columns or pk_expression")
        if self.key_expression and ";" in self.key_expression:
            raise ValueError("pk_expression must be a single expression without semicolons")
        if len(set(self.pk_columns)) != len(self.pk_columns):
            raise ValueError("pk_columns contains a column twice")
        for column, tolerance in self.column_tolerances.items():
            if isinstance(tolerance, Seconds) and not (math.isfinite(tolerance.seconds) and tolerance.seconds >= 0):
                raise ValueError(f"Seconds tolerance of column {column!r} must be finite and not negative")
        _one_of("on_type_mismatch", self.on_type_mismatch, TYPE_MISMATCH_MODES)
        _one_of("on_duplicates", self.on_duplicates, ("count", "pairs", "error"))
        _one_of("where_scope", self.where_scope, ("all", "join"))
        _one_of("null_keys", self.null_keys, ("once", "both_sides"))
        if self.hot_key_rows < 1 or self.max_hot_keys < 1:
            raise ValueError("hot_key_rows and max_hot_keys must be positive")

    @property
    def key_expression(self) -> str | None:
        return (self.pk_expression or "").strip() or None

    @property
    def row_filter(self) -> str | None:
        return (self.where_clause or "").strip() or None

    @property
    def key_names(self) -> list[str]:
        """Names of the key parts in the flat result: the key columns, or ``expr``."""
        return ["expr"] if self.key_expression else list(self.pk_columns)

    @classmethod
    def from_dict(cls, spec: Mapping[str, Any]) -> DiffConfig:
        """Read a configuration from its JSON form; absent and null entries take their defaults."""
        values = {name: value for name, value in spec.items() if value is not None}
        if "column_tolerances" in values:
            values["column_tolerances"] = {
                column: tolerance_from_dict(tolerance) for column, tolerance in values["column_tolerances"].items()
            }
        return cls(**values)


def _one_of(name: str, value: str, allowed: Sequence[str]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")
