"""Counting pairs of points that lie within a distance of each other, on one axis or on several, without building pairs.

Every row of A asks for the weight of B in a box around it. One axis or two are counted in strips: rows sorted by group and
place are cut at quantiles of all asked and given places, by the first axis and once more by the second. A box asks the
strips of the first axis that hold its ends for the rows they hold; for the strips between, the strips of the second axis
that hold its ends there; what is left are whole strips on both axes, counted from their sums. So a row takes part in a few
strips whatever the distances and however many rows share a key, and a task holds the rows of B of one strip
(:mod:`twinframe.functions.counting`), while boxes pass by.

All axes but the last two are taken apart first. An axis is cut into cells one longer than the reach: rows in the same cell
are near, rows in neighbouring cells are if the one of B lies at or below (above) a place that the one of A names, and
others are not. For neighbours, rows are ranked along the axis. A row of B belongs to the dyadic intervals of ranks that hold
it as their left half, and the ranks up to a named place are a sum of such intervals, one for each bit of their number. So
what is left to ask in a cell or an interval concerns the remaining axes alone, and the work is the rows times the logarithm
of the rows in a cell for each axis taken apart. Groups travel as 128-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinframe.functions.counting import answered, dealt
from twinframe.session import stored

# Rows of a stretch of the axis that running sums take in one go, and stretches at most; beyond them stretches grow.
STRETCH_ROWS = 10_000
STRETCHES = 4096
# Rows of a strip that one task answers for, and strips of an axis at most; beyond them strips grow.
STRIP_ROWS = 250_000
STRIPS = 2048
GROUP = ("h0", "h1")


def quantile_bounds(rows: DataFrame, place: str, per_stretch: int | None = None) -> list[int]:
    """Places that cut ``rows`` into stretches of about ``per_stretch`` rows, in ascending order; known to 1/16384 of the rows."""
    # Written as text: a column object for each share would take longer than the pass.
    shares = ", ".join(f"{i / STRETCHES}D" for i in range(1, STRETCHES))
    cuts = F.expr(f"percentile_approx({place}, array({shares}), {4 * STRETCHES})")
    found = rows.agg(F.count("*").alias("rows"), cuts.alias("cuts")).first()
    count = min(STRETCHES, -(-found.rows // (per_stretch or STRETCH_ROWS)))
    return sorted({found.cuts[STRETCHES * i // count - 1] for i in range(1, count)})


def stretch_of(place: str, bounds: list[int]) -> Column:
    """How many of ``bounds`` lie below a place, by binary search."""
    if not bounds:
        return F.lit(0)
    cuts = F.expr(f"array({', '.join(f'{cut}L' for cut in bounds)})")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    reached = lambda at, step: (at + step <= len(bounds)) & (F.get(cuts, at + step - 1) < F.col(place))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(reached(at, step), at + step).otherwise(at))


def _earlier(placed: DataFrame, by: list[str], value: str) -> DataFrame:
    """(``by``, stretch, before, whole): the sum of ``value`` over the stretches before, and over all of the group."""
    totals = placed.groupBy(*by, "stretch").agg(F.sum(value).alias("total"))
    ahead = Window.partitionBy(*by).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("total").over(Window.partitionBy(*by))
    return totals.select(*by, "stretch", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("before"), whole.alias("whole"))


def _digest(parts: list[str]) -> list[Column]:
    return [F.expr(f"xxhash64({', '.join(parts)})").alias("h0"), F.expr(f"xxhash64('second', {', '.join(parts)})").alias("h1")]


def _merged(events: DataFrame, by: list[str]) -> DataFrame:
    return stored(events.groupBy(*by).agg(F.sum("w").alias("w"), F.sum("asks").alias("asks")), "events")


def _struct(names: str, *values: str) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in zip(names.split(), values, strict=True)) + ")"


def _split(of_b: list[str], of_a: list[str]) -> Column:
    """Rows made of the structs ``of_b`` from rows of B and of ``of_a`` from rows of A."""
    return F.expr(f"inline(concat(if(w > 0, array({', '.join(of_b)}), array()), if(asks != 0, array({', '.join(of_a)}), array())))")


def _taken_apart(events: DataFrame, axis: str, reach: int, rest: list[str]) -> DataFrame:
    """Events on the remaining axes: groups become cells of ``axis``, or dyadic intervals of ranks in them."""

    def turned(move: int, ways: dict[int, str], w: str, asks: str) -> list[str]:
        cell = f"({axis} - pmod({axis}, {reach + 1}L)) DIV {reach + 1}L"
        return [_struct("cell way z w asks", f"{cell} + {move * way}L", str(way), place, w, asks) for way, place in ways.items()]

    of_b = turned(0, {0: "0L", 1: axis, -1: f"-{axis}"}, "w", "0L")
    of_a = turned(1, {0: "0L", 1: f"{axis} + {reach}L", -1: f"{reach}L - {axis}"}, "0L", "asks")
    ways = events.select(*GROUP, *rest, _split(of_b, of_a))
    by = [*GROUP, "cell", "way"]
    known = _merged(ways, [*by, "z", *rest])
    placed = known.withColumn("stretch", stretch_of("z", quantile_bounds(known, "z"))).withColumn("one", F.lit(1))
    ranked = placed.withColumn("place", F.rank().over(Window.partitionBy(*by, "stretch").orderBy("z")))
    sides = placed.groupBy(*by).agg(F.sum("w").alias("given"), F.sum("asks").alias("asked")).where("given > 0 AND asked > 0")
    earlier = _earlier(placed, by, "one").join(sides, by, "left_semi")
    ranked = ranked.join(earlier, [*by, "stretch"]).withColumn("r", F.expr("before + place - 1"))
    # A row of B at rank r counts in the left halves that hold it; the ranks 0 to r are one left half for each bit of r + 1.
    levels = "sequence(0, length(bin(whole)) - 1)"
    row = lambda *values: _struct("level node w asks", *values)
    given = f"transform(filter({levels}, l -> w > 0 AND shiftright(r, l) % 2 = 0), l -> {row('l', 'shiftright(r, l)', 'w', '0L')})"
    asked = f"transform(filter({levels}, l -> asks > 0 AND shiftright(r + 1, l) % 2 = 1), l -> {row('l', 'shiftright(r + 1, l) - 1', '0L', 'asks')})"
    parts = f"inline(if(way = 0, array({row('-1', '0L', 'w', 'asks')}), concat({given}, {asked})))"
    return ranked.select(*by, *rest, F.expr(parts)).select(*_digest([*by, "level", "node"]), *rest, "w", "asks")


def near_rows(rows: DataFrame, by: list[str], reaches: dict[str, int]) -> DataFrame:
    """``n``: pairs of a row of A and a row of B that agree in ``by`` and lie within the reach in every column of ``reaches``.

    ``rows`` carry their numbers on both sides, ``in_a`` and ``in_b``. NULL agrees with NULL, and is near NULL only.
    """
    axes = sorted(reaches, key=reaches.get)
    distinct = rows.groupBy(*by, *axes).agg(F.sum("in_a").cast("bigint").alias("asks"), F.sum("in_b").cast("bigint").alias("w"))
    # A hash passes over NULLs, so which parts are NULL is part of the group.
    marks = distinct.select("*", *[F.col(c).isNull().alias(f"null{i}") for i, c in enumerate([*by, *axes])])
    parts = [*[f"`{c}`" for c in by], *[f"null{i}" for i in range(len(by) + len(axes))]]
    left = [f"p{i}" for i in range(len(axes))]
    events = marks.select(*_digest(parts), *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(p) for c, p in zip(axes, left, strict=True)], "w", "asks")
    apart = len(axes) - 2
    for number, (p, c) in enumerate(zip(left[:apart] if apart > 0 else [], axes, strict=False)):
        events = _taken_apart(events, p, reaches[c], left[number + 1 :])
    last = left[-2:]
    events = events.select(*GROUP, *[F.col(p).alias(f"p{i}") for i, p in enumerate(last)], "w", "asks")
    return _in_strips(events, [reaches[c] for c in axes[-2:]], apart > 0)


def _bounds(events: DataFrame, reaches: list[int]) -> list[list[np.ndarray]]:
    """Per axis, the group, the place and the other place that cut the places of points and the ends of boxes into even strips."""
    rows = events.count()
    strips = min(STRIPS, -(-rows // STRIP_ROWS))
    # Only the cuts come from a part of the rows, so that the driver sees a hundred for each strip; all rows are dealt by them.
    share = max(1, rows // (100 * strips + 1))
    names = [f"p{i}" for i in range(len(reaches))]
    seen = events.where(F.pmod(F.xxhash64(F.lit("cuts"), *GROUP, *names), F.lit(share)) == 0)
    known = seen.select("h0", *names, F.col("asks") > 0).toArrow()
    h0, *places, asks = [column.to_numpy() for column in known.columns]
    bounds = []
    for i, reach in enumerate(reaches):
        others = [places[j] for j in range(len(reaches)) if j != i]
        ends = [(h0[asks], places[i][asks] + way * reach, *[other[asks] for other in others]) for way in (-1, 1)]
        columns = [np.concatenate(column) for column in zip((h0, places[i], *others), *ends, strict=True)]
        order = np.lexsort(columns[::-1])
        cuts = order[[len(order) * k // strips for k in range(1, strips)]] if len(order) else order
        bounds.append([column[cuts] for column in columns])
    return bounds


def _in_strips(events: DataFrame, reaches: list[int], repeated: bool) -> DataFrame:
    """``n``: the sum over boxes of asks times the weight within the reaches, in the same group, on one axis or two."""
    axes = range(len(reaches))
    known = _merged(events, [*GROUP, *[f"p{i}" for i in axes]]) if repeated else stored(events, "events")
    bounds = _bounds(known, reaches)
    names = ["h0", "h1", "w", "asks", *[f"{x}{i}" for i in axes for x in ("at", "long")]]
    schema = ", ".join(f"{name} bigint" for name in ["part", *names])

    def parts(whole: bool) -> DataFrame:
        return known.mapInArrow(lambda batches: dealt(batches, bounds, reaches, whole), schema)

    rows = parts(False)
    # Strips that lie wholly within a box on every axis are asked together; there are some only where a group fills three.
    if all(len(cut[0]) > 1 and (cut[0][1:] == cut[0][:-1]).any() for cut in bounds):
        summed = [F.sum(x).alias(x) for x in ("w", "asks")]
        kept = [name for name in names if name not in ("w", "asks")]
        # A box of one strip has the place of a point, so the two are told apart.
        of_box = (F.col("asks") > 0).alias("of_box")
        rows = rows.unionByName(parts(True).groupBy("part", *kept, of_box).agg(*summed).drop("of_box"))
    strips = rows.repartition("part").sortWithinPartitions("part", F.col("asks") > 0)
    found = strips.mapInArrow(lambda batches: answered(batches, len(reaches)), "n string")
    return found.agg(F.expr("CAST(coalesce(sum(CAST(n AS DECIMAL(38,0))), 0) AS DECIMAL(38,0)) AS n"))


def near_pairs(points: DataFrame, by: list[str], position: str, reach: int) -> DataFrame:
    """``n``: pairs of a row of A and a row of B that agree in ``by`` and lie within ``reach``."""
    return near_rows(points, by, {position: reach})
