"""Twinframe compares two tables on Spark: keys, schemas, cells within tolerances, drill-down and export."""

from twinframe.config import (
    CaseInsensitive,
    CaseInsensitiveWhitespace,
    DiffConfig,
    Precision,
    Seconds,
    Whitespace,
    tolerance_from_dict,
)
from twinframe.operators.schema import compare_schemas, key_candidates, suggest_keys, table_meta
from twinframe.plans.comparison import Comparison, compare

__all__ = [
    "CaseInsensitive",
    "CaseInsensitiveWhitespace",
    "Comparison",
    "DiffConfig",
    "Precision",
    "Seconds",
    "Whitespace",
    "compare",
    "compare_schemas",
    "key_candidates",
    "suggest_keys",
    "table_meta",
    "tolerance_from_dict",
]
