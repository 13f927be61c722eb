"""Statistics over all matched pairs, per column and per row class.

Three exact ways lead to the same one-row result:

* ``from_pairs`` joins the rows and aggregates the flags in the same stage. It suits keys that are (nearly) unique.
* ``from_keys`` deals rows out by key once and counts equal labels of each key in the task that holds it. It suits keys that
  repeat, but not so much that the rows of one would fill a task.
* ``from_groups`` never builds a pair either. Cells that compare equal share a label (see
  :mod:`twinframe.functions.compare`), so the number of equal pairs is the sum over key and label of
  ``rows in A · rows in B``, which one grouping with map-side aggregation yields; cells that lie within a distance are
  counted by running sums along the axes (see :mod:`twinframe.operators.ranges`). Its cost is linear in the rows however often a key repeats, so it serves hot
  keys and tables whose keys repeat so much that pairs outgrow rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.functions.compare import tolerated_micros
from twinframe.functions.counting import by_keys
from twinframe.operators.keys import PAIRS, total, unchanged_pairs
from twinframe.operators.pairs import with_flags
from twinframe.operators.ranges import near_pairs, near_rows
from twinframe.operators.sides import Layout, Side, has_null

STAT_CELLS = "array<struct<ordinal:int,name:string,diff_count:bigint,minor_count:bigint,total:bigint>>"
# Types whose values hash alike if and only if they compare equal.
HASHABLE = (T.NumericType, T.BooleanType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)
ROW_TOTALS = ("pairs", "rows_with_diffs", "rows_minor", "rows_identical")


def stat_columns(layout: Layout) -> list[str]:
    """Columns of a statistics row: totals over rows, then differing (``d<i>``) and minor (``m<i>``) cells per column."""
    return [*ROW_TOTALS, *layout.flags, *[f"m{i}" for i in range(len(layout.compared))]]


def from_pairs(pairs: DataFrame, layout: Layout) -> DataFrame:
    flagged = with_flags(pairs, layout).select(*layout.flags, *layout.raw_flags)
    return aggregate_flags(flagged, layout)


def aggregate_flags(flagged: DataFrame, layout: Layout) -> DataFrame:
    """One statistics row from flagged, matched pairs."""
    # A column compared exactly has one flag for both questions, so only the others are counted twice.
    loose = [i for i, comparator in enumerate(layout.comparators) if not comparator.exact]
    differs = " OR ".join(["false", *layout.flags])
    changed = " OR ".join([differs, *[f"r{i}" for i in loose]])
    counts = {
        "pairs": "count(1)",
        "rows_with_diffs": f"count_if({differs})",
        "rows_minor": f"count_if(({changed}) AND NOT ({differs}))",
        "rows_identical": f"count_if(NOT ({changed}))",
    }
    counts |= {flag: f"count_if({flag})" for flag in layout.flags}
    counts |= {
        f"m{i}": f"count_if(r{i} AND NOT d{i})" if i in loose else "0L" for i in range(len(layout.compared))
    }
    return flagged.selectExpr(*[f"{text} AS {name}" for name, text in counts.items()])


def from_groups(rows_a: DataFrame, rows_b: DataFrame, layout: Layout) -> DataFrame:
    """One statistics row counted from value groups; ``rows_a`` and ``rows_b`` are positional rows of each side.

    First, rows with the same key and values are merged over both sides into one row with two counts. Each then takes
    part in several questions, and per question the counts are added up by key and label.
    """
    n = len(layout.compared)
    loose = [i for i, comparator in enumerate(layout.comparators) if not comparator.exact]
    distant = [i for i in loose if layout.comparators[i].by_distance]

    # What each question groups by, besides the key: one column, or whole rows within tolerances.
    labels_of: dict[str, list[str]] = {"pairs": [], "raw": []}
    labels_of |= {f"raw{i}": [f"raw{i}"] for i in range(n)}
    labels_of |= {f"tol{i}": [f"tol{i}"] for i in loose if i not in distant}
    # Distances do not group; the questions that have some are answered apart.
    row_labels = [f"tol{i}" if i in loose else f"raw{i}" for i in range(n) if i not in distant]
    if loose and not distant:
        labels_of["tol"] = row_labels
    number = {question: position for position, question in enumerate(labels_of)}

    both = _tagged(rows_a, rows_b, layout)
    content = [name for name in both.columns if name not in ("in_a", "in_b")]
    merged = both.groupBy(*content).agg(F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b"))
    keys = [name for name in merged.columns if name.startswith("k")]
    forms = {f"raw{i}": F.col(f"v{i}") for i in range(n)}
    forms |= {f"tol{i}": layout.comparators[i].form(F.col(f"v{i}")) for i in loose if i not in distant}
    table = merged.select("*", F.explode(F.array(*map(F.lit, number.values()))).alias("question"))
    # Merged rows are the groups of the question for equal rows, so its answer needs no further grouping.
    table = table.withColumns(
        {
            "met": F.expr(f"CASE WHEN question = {number['raw']} THEN {PAIRS} ELSE 0 END"),
            **{f"in_{x}": F.expr(f"CASE WHEN question = {number['raw']} THEN 0L ELSE in_{x} END") for x in "ab"},
        }
    )
    for label in sorted({label for labels in labels_of.values() for label in labels}):
        answering = [number[q] for q, labels in labels_of.items() if label in labels]
        table = table.withColumn(label, F.when(F.col("question").isin(answering), forms[label]))
    group = [*keys, "question", *[name for name in table.columns if name.startswith(("raw", "tol"))]]
    grouped = (
        table.groupBy(*group)
        .agg(*[F.sum(name).alias(name) for name in ("in_a", "in_b", "met")])
        .where("in_a > 0 AND in_b > 0 OR met > 0")
    )
    equal_pairs = grouped.selectExpr(
        *[
            f"{total('met' if question == 'raw' else PAIRS, f'question = {position}')} AS {question}"
            for question, position in number.items()
        ]
    )

    # Counting within distances merges equal rows itself.
    near = {f"tol{i}": near_pairs(both, keys, f"v{i}", _reach(layout, i)) for i in distant}
    if distant:
        formed = both.select(*keys, *[forms[x].alias(x) for x in row_labels], *[f"v{i}" for i in distant], "in_a", "in_b")
        reaches = {f"v{i}": _reach(layout, i) for i in distant}
        near["tol"] = near_rows(formed, [*keys, *row_labels], reaches)
    if near:
        parts = [equal_pairs, *[answer.select(F.col("n").alias(question)) for question, answer in near.items()]]
        united = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
        equal_pairs = united.agg(*[F.sum(question).alias(question) for question in [*number, *near]])

    return _answers(equal_pairs, layout)


def _answers(equal_pairs: DataFrame, layout: Layout) -> DataFrame:
    """The statistics row from the numbers of pairs that agree: ``pairs``, ``raw``, ``raw<i>``, ``tol``, ``tol<i>``."""
    n = len(layout.compared)
    loose = [i for i, comparator in enumerate(layout.comparators) if not comparator.exact]

    def tolerant(i: int | str) -> str:
        return f"tol{i}" if i in loose or (i == "" and loose) else f"raw{i}"

    answers = {
        "pairs": "pairs",
        "rows_with_diffs": f"pairs - {tolerant('')}",
        "rows_minor": f"{tolerant('')} - raw",
        "rows_identical": "raw",
    }
    answers |= {f"d{i}": f"pairs - {tolerant(i)}" for i in range(n)}
    answers |= {f"m{i}": f"{tolerant(i)} - raw{i}" for i in range(n)}
    return equal_pairs.selectExpr(*[f"CAST({answers[name]} AS BIGINT) AS {name}" for name in stat_columns(layout)])


def can_count_by_keys(layout: Layout, keys: DataFrame) -> bool:
    """Whether :func:`from_keys` serves: key parts and values that hash as they compare, and no more than two distances."""
    types = [keys.schema[name].dataType for name in keys.columns] + [c.dtype for c in layout.comparators]
    return all(map(_hashable, types)) and sum(c.by_distance for c in layout.comparators) <= 2


def _hashable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StringType):
        return dtype.isUTF8BinaryCollation()
    return isinstance(dtype, HASHABLE)


def from_keys(rows_a: DataFrame, rows_b: DataFrame, layout: Layout) -> DataFrame:
    """One statistics row like :func:`from_groups`, for keys whose rows fit a task: rows are dealt out by key once.

    Each task then has its keys' rows in order and answers all questions from them, batch by batch, so what is shuffled
    does not grow with the number of questions. Labels are 64-bit hashes, which only have to tell rows of one key apart.
    """
    n = len(layout.compared)
    loose = [i for i, comparator in enumerate(layout.comparators) if not comparator.exact]
    distant = [i for i in loose if layout.comparators[i].by_distance]
    both = _tagged(rows_a, rows_b, layout)
    keys = [f"k{i}" for i in range(len(layout.keys))]

    def label(*values: Column) -> Column:
        """NULLs are passed over by a hash, so a number tells where they stand."""
        nulls = [v.isNull() for v in values]
        return F.xxhash64(*values, *nulls)

    forms = {f"raw{i}": F.col(f"v{i}") for i in range(n)}
    forms |= {f"tol{i}": layout.comparators[i].form(F.col(f"v{i}")) for i in loose if i not in distant}
    forms |= {f"tol{i}": F.col(f"v{i}").isNull() for i in distant}
    hashed = {name: label(form) for name, form in forms.items()}
    axes = {i: (f"p{i}", _reach(layout, i)) for i in distant}
    questions: dict[str, tuple[str | None, list[tuple[str, int]]]] = {"pairs": (None, [])}
    if n:
        hashed["raw"] = label(*[F.col(f"v{i}") for i in range(n)])
    questions["raw"] = ("raw" if n else None, [])
    questions |= {f"raw{i}": (f"raw{i}", []) for i in range(n)}
    questions |= {f"tol{i}": (f"tol{i}", [axes[i]] if i in axes else []) for i in loose}
    if loose:
        hashed["tol"] = label(*[forms[f"tol{i}" if i in loose else f"raw{i}"] for i in range(n)])
        questions["tol"] = ("tol", list(axes.values()))
    places = [F.coalesce(F.col(f"v{i}").cast("bigint"), F.lit(0)).alias(f"p{i}") for i in distant]
    digests = [F.xxhash64(*keys).alias("h0"), F.xxhash64(F.lit("second"), *keys).alias("h1")]
    dealt = both.repartition(*keys).select(
        *digests, F.col("in_a").cast("bigint").alias("a"), *[form.alias(name) for name, form in hashed.items()], *places
    )
    columns, asked = dealt.columns, list(questions.values())
    schema = ", ".join(f"n{i} string" for i in range(len(questions)))
    counted = dealt.sortWithinPartitions("h0", "h1").mapInArrow(lambda batches: by_keys(batches, asked, columns), schema)
    sums = [F.expr(f"coalesce(sum(CAST(n{i} AS DECIMAL(38,0))), 0)").alias(name) for i, name in enumerate(questions)]
    return _answers(counted.agg(*sums), layout)


def _reach(layout: Layout, i: int) -> int:
    return tolerated_micros(layout.comparators[i].tolerance)


def _tagged(rows_a: DataFrame, rows_b: DataFrame, layout: Layout) -> DataFrame:
    """Rows of both sides, ``k0…, v0…``, with ``in_a`` and ``in_b``: 1 on their own side, else 0; rows with NULL keys left out."""

    def tagged(rows: DataFrame, side: str) -> DataFrame:
        keys = [F.col(name).alias(f"k{i}") for i, name in enumerate(layout.key(side))]
        values = [
            comparator.comparable_raw(comparator.position(F.col(name))).alias(f"v{i}")
            for i, (name, comparator) in enumerate(zip(layout.value(side), layout.comparators, strict=True))
        ]
        flags = [F.lit(int(side == own)).alias(f"in_{own}") for own in "ab"]
        return rows.where(~has_null(layout.key(side))).select(*keys, *values, *flags)

    return tagged(rows_a, "a").unionAll(tagged(rows_b, "b"))


def added(parts: list[DataFrame], layout: Layout) -> DataFrame:
    """Sum of several statistics rows over disjoint sets of pairs."""
    if len(parts) == 1:
        return parts[0].select(*stat_columns(layout))
    united = reduce(DataFrame.unionByName, parts)
    return united.agg(*[F.sum(name).alias(name) for name in stat_columns(layout)])


def unchanged(index: DataFrame, names: list[str], layout: Layout, below: int | None) -> DataFrame:
    """One statistics row for the pairs that a key index knows to be equal (see ``unchanged_pairs``)."""
    same = index.selectExpr(f"CAST({unchanged_pairs(names, below)} AS BIGINT) AS pairs")
    zeros = [F.lit(0).cast("long").alias(name) for name in stat_columns(layout) if name not in ("pairs", "rows_identical")]
    return same.select("pairs", F.col("pairs").alias("rows_identical"), *zeros).select(*stat_columns(layout))


def column_stats(stats: DataFrame, layout: Layout) -> DataFrame:
    """One row per compared column: ``ordinal, name, diff_count, minor_count, match_count, total, match_pct, diff_pct``."""
    if not layout.compared:
        stats = stats.where(F.lit(False))
    cells = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(name).alias("name"),
            F.col(f"d{i}").alias("diff_count"),
            F.col(f"m{i}").alias("minor_count"),
            F.col("pairs").alias("total"),
        )
        for i, name in enumerate(layout.compared)
    ]
    listed = F.array(*cells).cast(STAT_CELLS)
    match_count, diffs, compared = F.col("total") - F.col("diff_count"), F.col("diff_count"), F.col("total")
    return stats.select(F.inline(listed)).select(
        "ordinal",
        "name",
        "diff_count",
        "minor_count",
        match_count.alias("match_count"),
        "total",
        F.when(compared > 0, match_count / compared * 100.0).otherwise(100.0).alias("match_pct"),
        F.when(compared > 0, diffs / compared * 100.0).otherwise(0.0).alias("diff_pct"),
    )


def ranked(stats: DataFrame) -> DataFrame:
    """Column statistics, most differences first."""
    return stats.orderBy(F.col("diff_count").desc(), "ordinal")
