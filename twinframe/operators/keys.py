"""Key analysis: counts per key, hot keys, duplicate keys, rows with or without a partner.

Everything here starts from one grouping of both tables by key. It carries only the key and two counters, and the
map-side part of the aggregation reduces a hot key to one row per task before the shuffle, so its cost does not depend
on skew. Joins downstream use its result to keep hot keys out of plain key-partitioned joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.config import DiffConfig
from twinframe.operators.schema import quoted
from twinframe.operators.sides import SOURCE_KEY, Layout, Side, has_null
from twinframe.session import stored

# Rows of each side that meet in one cell of a split hot key.
CELL_ROWS = 10_000

PAIRS = "CAST(in_a AS DECIMAL(19,0)) * CAST(in_b AS DECIMAL(19,0))"


def total(value: str, when: str | None = None) -> str:
    """SQL text of a sum (over rows where ``when``) that is 0 for no rows."""
    return f"coalesce(sum({value}){f' FILTER (WHERE {when})' if when else ''}, 0)"


def key_counts(a: Side, b: Side, filtered: bool = True) -> DataFrame:
    """Rows per key value on each side: ``k0…, in_a, in_b``. NULL is a value like any other here."""
    a_keys = a.keys_of(a.filtered if filtered else a.source)
    b_keys = b.keys_of(b.filtered if filtered else b.source)
    names = a_keys.columns
    tagged = a_keys.select(*names, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionAll(
        b_keys.select(*names, F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    )
    return tagged.groupBy(*names).agg(F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b"))


def key_index(a: Side, b: Side, layout: Layout) -> DataFrame:
    """:func:`key_counts` with ``changed``: 1 if both sides have the key and not all of its rows have equal values, else 0.

    Values are compared by 128-bit digests, so what is shuffled does not depend on the width of the rows, and a hot key
    is reduced in the map tasks. Equal digests mean equal cells, with NULL told from every value. Digests of nested values
    would not tell where a NULL stands, so with nested columns every key of both sides counts as changed.
    """
    names = key_names(a)
    parts = []
    for side in (a, b):
        values = [F.col(name) for name in layout.value(side.name)]
        content = [*values, *[value.isNull() for value in values]]
        keys = [F.col(x).alias(y) for x, y in zip(layout.key(side.name), names, strict=True)]
        counts = [F.lit(int(side.name == x)).alias(f"in_{x}") for x in "ab"]
        nested = any(not isinstance(c.dtype, T.AtomicType) or isinstance(c.dtype, T.VariantType) for c in layout.comparators)
        hashes = [F.lit(0), F.lit(0)] if nested or not values else [F.xxhash64(*content), F.xxhash64(F.lit("second"), *content)]
        parts.append(side.rows.select(*keys, *counts, hashes[0].alias("h0"), hashes[1].alias("h1")))
    grouped = parts[0].unionAll(parts[1]).groupBy(*names)
    facts = grouped.agg(
        F.sum("in_a").alias("in_a"),
        F.sum("in_b").alias("in_b"),
        *[which(name).alias(f"{label}_{name}") for name in ("h0", "h1") for label, which in (("min", F.min), ("max", F.max))],
    )
    differs = "true" if nested else "min_h0 <> max_h0 OR min_h1 <> max_h1"
    changed = f"NOT {_null_key(names)} AND in_a > 0 AND in_b > 0 AND ({differs})"
    # A number and not a boolean: a comparison with a constant is what makes Spark try a Bloom filter on the other side.
    return facts.selectExpr(*names, "in_a", "in_b", f"CAST({changed} AS INT) AS changed")


def changed_keys(index: DataFrame) -> DataFrame:
    return index.where("changed = 1").drop("in_a", "in_b", "changed")


def unchanged_pairs(names: list[str], below: int | None) -> str:
    """SQL text of the pairs of unchanged keys in a key index, of those with fewer rows than ``below`` on either side."""
    cold = "true" if below is None else f"greatest(in_a, in_b) < {below}"
    return total(PAIRS, f"changed = 0 AND NOT {_null_key(names)} AND in_a > 0 AND in_b > 0 AND {cold}")


def key_names(side: Side) -> list[str]:
    return [f"k{i}" for i in range(len(side.key_columns))]


def _null_key(names: list[str]) -> str:
    return "(" + " OR ".join(f"{name} IS NULL" for name in names) + ")"


def _named(texts: dict[str, str]) -> list[str]:
    return [f"{text} AS {name}" for name, text in texts.items()]


def key_profile(a: Side, b: Side, config: DiffConfig, counts: DataFrame | None = None) -> DataFrame:
    """Totals over :func:`key_counts` (``counts`` if given) by size class of the keys, a few dozen rows at most.

    Class 0 holds the keys with fewer than ``hot_key_rows`` rows on either side; each further class starts at twice the
    size of the one before, so class c > 0 starts at hot_key_rows · 2^(c-1).
    """
    names = key_names(a)
    null_key = _null_key(names)
    all_null = " AND ".join(f"{name} IS NULL" for name in names)
    matched = f"NOT {null_key} AND in_a > 0 AND in_b > 0"
    size, first = "greatest(in_a, in_b)", config.hot_key_rows
    size_class = f"CASE WHEN {null_key} OR {size} < {first} THEN 0 ELSE length(bin({size} DIV {first})) END"
    totals = {
        "total_rows_a": total("in_a"),
        "total_rows_b": total("in_b"),
        "exclusive_a": total("in_a", f"NOT ({matched})"),
        "exclusive_b": total("in_b", f"NOT ({matched})"),
        **_problem_counts(names),
        "all_null_a": total("in_a", all_null),
        "all_null_b": total("in_b", all_null),
        "pairs": total(PAIRS, matched),
        "multiplied": total(PAIRS, f"{matched} AND in_a > 1 AND in_b > 1"),
        "most_pairs": f"coalesce(max({PAIRS}) FILTER (WHERE {matched}), 0)",
        "keys": "count(1)",
    }
    counts = key_counts(a, b) if counts is None else counts
    classed = counts.selectExpr("*", f"{size_class} AS size_class")
    return classed.groupBy("size_class").agg(*[F.expr(text).alias(name) for name, text in totals.items()])


@dataclass(frozen=True)
class KeyTotals:
    """What is known about the keys of a comparison before it is made."""

    total_rows_a: int
    total_rows_b: int
    exclusive_a: int
    exclusive_b: int
    duplicate_pks_a: int
    duplicate_pks_b: int
    null_pks_a: int
    null_pks_b: int
    all_null_a: int
    all_null_b: int
    pairs: int
    multiplied: int
    """Pairs of keys that repeat on both sides."""
    hot_from: int
    """Rows of one side from which a key is hot."""
    hot_keys: int
    cold_pairs: int
    """Pairs of keys that are not hot."""
    most_pairs: int
    """Pairs of the key that has most of them."""

    def of(self, fact: str, side: str) -> int:
        return getattr(self, f"{fact}_{side}")


def key_totals(profile: list[Row], config: DiffConfig) -> KeyTotals:
    """Sum up a fetched :func:`key_profile` and draw the line between cold and hot keys.

    It is drawn at ``hot_key_rows``, or at the lowest size class that leaves at most ``max_hot_keys`` above it.
    """
    summed = ["total_rows", "exclusive", "duplicate_pks", "null_pks", "all_null"]
    names = [f"{fact}_{side}" for fact in summed for side in "ab"] + ["pairs", "multiplied"]
    sums = {name: sum(int(row[name]) for row in profile) for name in names}
    line = 1
    while sum(row["keys"] for row in profile if row.size_class >= line) > config.max_hot_keys:
        line += 1
    return KeyTotals(
        **sums,
        hot_from=config.hot_key_rows << (line - 1),
        hot_keys=sum(row["keys"] for row in profile if row.size_class >= line),
        cold_pairs=sum(int(row.pairs) for row in profile if row.size_class < line),
        most_pairs=max((int(row.most_pairs) for row in profile), default=0),
    )


def unfiltered_problem_counts(a: Side, b: Side) -> DataFrame:
    """Duplicate and NULL key counts of the tables as given, before the row filter."""
    return key_counts(a, b, filtered=False).selectExpr(*_named(_problem_counts(key_names(a))))


def _problem_counts(names: list[str]) -> dict[str, str]:
    return {
        "duplicate_pks_a": "count_if(in_a > 1)",
        "duplicate_pks_b": "count_if(in_b > 1)",
        "null_pks_a": total("in_a", _null_key(names)),
        "null_pks_b": total("in_b", _null_key(names)),
    }


@dataclass(frozen=True)
class HotKeys:
    """The hot keys with their exact row counts, ``in_a, in_b``, and the parts to split each side into.

    A key is known by a 128-bit hash, ``h0, h1``, so a row is of fixed width whatever the keys are, and the table of at
    most ``max_hot_keys`` rows (less than 1 MB) can be broadcast. Keys outside it have fewer than ``hot_from`` rows on
    either side.
    """

    table: DataFrame
    names = ("h0", "h1")

    def _on(self, keys: list[str]) -> list[Column]:
        return [F.col(name) == digest for name, digest in zip(self.names, _digest(keys), strict=True)]

    def cold(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """Rows of other keys."""
        return df.join(F.broadcast(self.table), self._on(keys), "left_anti")

    def hot(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """Rows of hot keys, with ``in_a, in_b, parts_a, parts_b``."""
        return df.join(F.broadcast(self.table), self._on(keys), "inner").drop(*self.names)


def hot_keys(a: Side, b: Side, totals: KeyTotals, counts: DataFrame | None = None) -> HotKeys:
    names = key_names(a)
    hot = f"NOT {_null_key(names)} AND greatest(in_a, in_b) >= {totals.hot_from}"
    digests = [digest.alias(name) for name, digest in zip(HotKeys.names, _digest(names), strict=True)]
    counts = key_counts(a, b) if counts is None else counts
    table = counts.where(hot).select(*digests, "in_a", "in_b", _parts("in_a", totals), _parts("in_b", totals))
    return HotKeys(stored(table, "hot-keys"))


def _digest(keys: list[str]) -> list[Column]:
    return [F.xxhash64(*keys), F.xxhash64(F.lit("second"), *keys)]


def _parts(count: str, totals: KeyTotals) -> Column:
    needed = F.ceil(F.col(count) / F.lit(min(CELL_ROWS, totals.hot_from)))
    parts = F.greatest(needed, F.lit(1)).cast("int")
    return parts.alias(count.replace("in_", "parts_"))


def with_partner(
    one: Side, other: Side, totals: KeyTotals, hot: HotKeys | None, how: str, counts: DataFrame | None = None
) -> DataFrame:
    """Rows of ``one`` whose key occurs (``left_semi``) or does not occur (``left_anti``) in ``other``.

    The rows keep their own columns. Rows with a NULL key part match nothing and bypass the join; rows of hot keys
    bypass it too, since the hot-key table already says whether the other side has the key. From stored ``counts`` only
    the keys that decide are joined, and the other table is not read.
    """
    own = [f"{SOURCE_KEY}{i}" for i in range(len(one.key_columns))]
    theirs = key_names(other)
    keyed = one.keyed()
    rows = keyed.where(~has_null(own))
    join = how
    if counts is None:
        keys = other.keys_of(other.filtered)
    else:
        there = F.col(f"in_{other.name}")
        keys, join = counts.where(F.col(f"in_{one.name}") > 0).where(there == 0 if how == "left_anti" else there > 0), "left_semi"
    keys = keys.where(~has_null(theirs))
    keys = keys.select(*[F.col(name).alias(f"other_{name}") for name in theirs])
    equal = [F.col(x) == F.col(f"other_{y}") for x, y in zip(own, theirs, strict=True)]
    if hot is None:
        found = rows.join(keys, equal, join)
    else:
        partners = F.col(f"in_{other.name}")
        known = hot.hot(rows, own).where(partners > 0 if how == "left_semi" else partners == 0)
        cold = hot.cold(rows, own).join(hot.cold(keys, keys.columns), equal, join)
        found = cold.unionAll(known.select(*keyed.columns))
    if how == "left_anti" and totals.of("null_pks", one.name):
        found = found.unionAll(keyed.where(has_null(own)))
    return found.drop(*own)


def duplicate_keys(side: Side, config: DiffConfig, counts: DataFrame | None = None) -> DataFrame:
    """Key values that occur more than once, with their ``count``. NULL is a value like any other here."""
    if counts is not None and config.where_scope != "join":
        named = zip(key_names(side), ["pk_expr"] if config.key_expression else config.pk_columns, strict=True)
        found = [F.col(x).alias(y) for x, y in named]
        return counts.where(F.col(f"in_{side.name}") > 1).select(*found, F.col(f"in_{side.name}").alias("count"))
    source = side.source if config.where_scope == "join" else side.filtered
    names = ["pk_expr"] if config.key_expression else list(config.pk_columns)
    keys = source.select(*[key.alias(name) for key, name in zip(side.key_columns, names, strict=True)])
    grouped = keys.groupBy(*[quoted(name) for name in names]).agg(F.count(F.lit(1)).alias("count"))
    return grouped.where(F.col("count") > 1)
