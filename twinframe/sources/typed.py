"""Typed load of results that arrive as strings only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.operators.schema import quoted

# Declared warehouse types and the type each is loaded as; any other is loaded as string.
LOADED_AS = {
    "FIXED": "double",
    "NUMBER": "double",
    "DECIMAL": "double",
    "NUMERIC": "double",
    "REAL": "double",
    "FLOAT": "double",
    "FLOAT4": "double",
    "FLOAT8": "double",
    "DOUBLE": "double",
    "DOUBLE PRECISION": "double",
    "INTEGER": "bigint",
    "INT": "bigint",
    "BIGINT": "bigint",
    "SMALLINT": "bigint",
    "TINYINT": "bigint",
    "BYTEINT": "bigint",
    "BOOLEAN": "boolean",
    "DATE": "date",
    "TIMESTAMP_NTZ": "timestamp_ntz",
    "TIMESTAMP_LTZ": "timestamp",
    "TIMESTAMP_TZ": "timestamp",
    "TIMESTAMP": "timestamp_ntz",
    "DATETIME": "timestamp_ntz",
}


def loaded_type(declared: str) -> str:
    return LOADED_AS.get(declared.strip().upper(), "string")


def typed_load(df: DataFrame, declared: Mapping[str, str] | Sequence[tuple[str, str]], cells: str | None = None) -> DataFrame:
    """Cast string columns to their declared warehouse types, in declared order.

    With ``cells``, the strings are the elements of that array column: a short row is filled up with NULL, one with surplus
    elements raises. So does a value that does not fit its type. Times with an offset keep the moment they name.
    """
    columns = list(declared.items()) if isinstance(declared, Mapping) else list(declared)
    if not columns:
        raise ValueError("The result has no columns")
    if cells is not None:
        if not isinstance(df.schema[cells].dataType, T.ArrayType):
            raise ValueError(f"Column {cells!r} is not an array")
        row = F.col(quoted(cells))
        surplus = F.concat(F.lit(f"A row has more than {len(columns)} cells: "), F.to_json(row))
        fitting = F.when(F.size(row) > len(columns), F.raise_error(surplus).cast(df.schema[cells].dataType)).otherwise(row)
        texts = [F.get(fitting, F.lit(i)) for i in range(len(columns))]
    else:
        texts = [F.col(quoted(name)) for name, _ in columns]
    return df.select(
        *[text.cast(loaded_type(kind)).alias(name) for text, (name, kind) in zip(texts, columns, strict=True)]
    )
