"""The two tables made ready: filtered, keyed, brought to common types and given positional names.

Side ``a`` has columns ``ak0…`` (key parts), ``av0…`` (compared values), ``ai0…`` (ignored values); side ``b`` has
``bk0…``, ``bv0…``, ``bi0…``. Positional names keep user names, whatever their case or characters, out of joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.config import DiffConfig
from twinframe.functions.compare import Comparator, any_of, resolve
from twinframe.operators.schema import quoted, shared_columns

SOURCE_KEY = "__twinframe_k"


@dataclass(frozen=True)
class Layout:
    """Names of key parts, compared and ignored columns, with the comparator of each compared column."""

    keys: list[str]
    compared: list[str]
    ignored: list[str]
    comparators: list[Comparator]

    def key(self, side: str) -> list[str]:
        return [f"{side}k{i}" for i in range(len(self.keys))]

    def value(self, side: str) -> list[str]:
        return [f"{side}v{i}" for i in range(len(self.compared))]

    def ignored_value(self, side: str) -> list[str]:
        return [f"{side}i{i}" for i in range(len(self.ignored))]

    def all(self, side: str) -> list[str]:
        return self.key(side) + self.value(side) + self.ignored_value(side)

    @property
    def flags(self) -> list[str]:
        return [f"d{i}" for i in range(len(self.compared))]

    @property
    def raw_flags(self) -> list[str]:
        return [f"r{i}" for i in range(len(self.compared))]

    def value_names(self) -> list[tuple[str, str]]:
        """(internal, public) names of keys and values in result order."""
        names = []
        for prefix, users, kind in (("pk_", self.keys, "k"), ("", self.compared, "v"), ("", self.ignored, "i")):
            for i, user in enumerate(users):
                names += [(f"{side}{kind}{i}", f"{prefix}{user}_{side}") for side in "ab"]
        return names

    def flag_names(self) -> list[tuple[str, str]]:
        return [(f"d{i}", f"is_diff_{user}") for i, user in enumerate(self.compared)] + [
            (f"r{i}", f"is_raw_diff_{user}") for i, user in enumerate(self.compared)
        ]


@dataclass(frozen=True)
class Side:
    """One table: ``source`` is what the user gave, ``filtered`` after the row filter, ``rows`` the renamed columns."""

    name: str
    source: DataFrame
    filtered: DataFrame
    rows: DataFrame
    key_columns: list[Column]

    def keyed(self) -> DataFrame:
        """The filtered table with all its own columns plus the key parts under reserved names."""
        return self.filtered.select("*", *[key.alias(f"{SOURCE_KEY}{i}") for i, key in enumerate(self.key_columns)])

    def keys_of(self, df: DataFrame) -> DataFrame:
        return df.select(*[key.alias(f"k{i}") for i, key in enumerate(self.key_columns)])


def has_null(names: list[str]) -> Column:
    return any_of([F.col(name).isNull() for name in names])


def prepare(a: DataFrame, b: DataFrame, config: DiffConfig) -> tuple[Side, Side, Layout]:
    """Check the configuration against both tables and derive the sides. Starts no job."""
    for label, df in (("A", a), ("B", b)):
        if len({name.lower() for name in df.columns}) != len(df.columns):
            raise ValueError(f"Table {label} has columns whose names differ only by case")
    shared = shared_columns(a, b)
    keys_a, keys_b = _keys(a, "A", config), _keys(b, "B", config)
    for name in config.ignored_columns:
        if name not in shared:
            raise ValueError(f"Ignored column {name!r} is not in both tables")
        if name in config.pk_columns:
            raise ValueError(f"Key column {name!r} cannot be ignored")

    filtered_a, filtered_b = _where(a, "A", config), _where(b, "B", config)
    for i, name in enumerate(config.key_names):
        keys_a[i], keys_b[i], _ = _common(a, b, name, keys_a[i], keys_b[i], "coerce")

    compared, comparators, values_a, values_b = [], [], [], []
    for name in shared:
        if name in config.pk_columns or name in config.ignored_columns:
            continue
        column = F.col(quoted(name))
        same_type = a.schema[name].dataType == b.schema[name].dataType
        if not same_type and config.on_type_mismatch == "skip":
            continue
        if same_type:
            value_a, value_b, dtype = column, column, a.schema[name].dataType
        else:
            value_a, value_b, dtype = _common(a, b, name, column, column, config.on_type_mismatch)
        own = a.schema[name].dataType if config.on_type_mismatch == "coerce" else dtype
        tolerance = resolve(own, config.column_tolerances.get(name), config.tolerance).tolerance
        compared.append(name)
        comparators.append(resolve(dtype, tolerance, None))
        values_a.append(value_a)
        values_b.append(value_b)

    layout = Layout(config.key_names, compared, list(config.ignored_columns), comparators)
    public = [name.lower() for _, name in layout.value_names() + layout.flag_names()]
    if len(set(public)) != len(public):
        clash = sorted({name for name in public if public.count(name) > 1})
        raise ValueError(f"Result column names collide: {', '.join(clash)}")

    def side(label: str, source: DataFrame, filtered: DataFrame, keys: list[Column], values: list[Column]) -> Side:
        ignored = [F.col(quoted(name)) for name in layout.ignored]
        named = zip(layout.all(label), keys + values + ignored, strict=True)
        return Side(label, source, filtered, filtered.select(*[value.alias(name) for name, value in named]), keys)

    return side("a", a, filtered_a, keys_a, values_a), side("b", b, filtered_b, keys_b, values_b), layout


def _keys(df: DataFrame, label: str, config: DiffConfig) -> list[Column]:
    if config.key_expression:
        key = F.expr(config.key_expression)
        try:
            df.select(key)
        except AnalysisException as error:
            raise ValueError(f"Key expression does not fit table {label}: {error}") from error
        return [key]
    for name in config.pk_columns:
        if name not in df.columns:
            raise ValueError(f"Key column {name!r} does not exist in table {label}")
    return [F.col(quoted(name)) for name in config.pk_columns]


def _where(df: DataFrame, label: str, config: DiffConfig) -> DataFrame:
    if not config.row_filter:
        return df
    try:
        return df.where(F.expr(config.row_filter))
    except AnalysisException as error:
        raise ValueError(f"Row filter does not fit table {label}: {error}") from error


def _common(
    a: DataFrame, b: DataFrame, name: str, value_a: Column, value_b: Column, mode: str
) -> tuple[Column, Column, T.DataType]:
    """Bring two values to the type Spark would compare them in (or to strings)."""
    type_a = a.select(value_a.alias("v")).schema["v"].dataType
    type_b = b.select(value_b.alias("v")).schema["v"].dataType
    if type_a == type_b:
        return value_a, value_b, type_a
    if mode == "string":
        return value_a.cast("string"), value_b.cast("string"), T.StringType()
    if mode == "error":
        raise ValueError(f"Column {name!r} is {type_a.simpleString()} in A but {type_b.simpleString()} in B")
    both = F.coalesce(F.lit(None).cast(type_a), F.lit(None).cast(type_b)).alias("v")
    try:
        common = a.sparkSession.range(0).select(both).schema["v"].dataType
    except AnalysisException as error:
        raise ValueError(
            f"Column {name!r} is {type_a.simpleString()} in A and {type_b.simpleString()} in B, which do not compare; "
            "use on_type_mismatch='string' or 'skip'"
        ) from error
    return value_a.cast(common), value_b.cast(common), common
