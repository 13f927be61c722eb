from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import overview_of, stats_of
from pyspark.sql import functions as F

from twinframe import (
    CaseInsensitive,
    CaseInsensitiveWhitespace,
    DiffConfig,
    Precision,
    Seconds,
    Whitespace,
    compare,
    tolerance_from_dict,
)
from twinframe.functions.compare import displayed, truncated
from twinframe.operators import ranges
from twinframe.operators.ranges import near_pairs, near_rows

T0 = datetime(2024, 1, 1, 12, 0, 0)


def doubles(frame, *pairs):
    schema = "id int, val double"
    a = frame(schema, *[(i, x) for i, (x, _) in enumerate(pairs)])
    b = frame(schema, *[(i, y) for i, (_, y) in enumerate(pairs)])
    return a, b


def strings(frame, *pairs):
    schema = "id int, name string"
    a = frame(schema, *[(i, x) for i, (x, _) in enumerate(pairs)])
    b = frame(schema, *[(i, y) for i, (_, y) in enumerate(pairs)])
    return a, b


def diffs(a, b, tolerance=None, column="val", **settings):
    tolerances = {column: tolerance} if tolerance else {}
    return stats_of(compare(a, b, pk_columns=["id"], column_tolerances=tolerances, **settings))[column][0]


def test_precision_truncates(frame):
    assert diffs(*doubles(frame, (0.1234, 0.1235), (0.1234, 0.1244)), Precision(2)) == 0
    assert diffs(*doubles(frame, (0.1234, 0.1239), (0.1234, 0.1254)), Precision(3)) == 1
    assert diffs(*doubles(frame, (-1.9, -1.1), (1.9, 2.0)), Precision(0)) == 1
    assert diffs(*doubles(frame, (19.0, 11.0), (19.0, 20.0)), Precision(-1)) == 1


def test_precision_and_null(frame):
    a, b = doubles(frame, (None, None), (None, 100.0), (100.0, None), (100.0, 100.4))
    assert diffs(a, b, tolerance=None) == 3
    assert stats_of(compare(a, b, pk_columns=["id"], tolerance=0)) == {"val": (2, 1)}


def test_precision_of_special_values(spark):
    values = [float("nan"), float("inf"), float("-inf"), 1e308, -1e308, 0.0, -2.57, 2.57]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    two = [r.t for r in frame.select("i", truncated(F.col("v"), 2).alias("t")).orderBy("i").collect()]
    assert two[0] != two[0] and two[1:5] == values[1:5] and two[5:] == [0.0, -2.57, 2.57]
    tens = [r.t for r in frame.select("i", truncated(F.col("v"), -1).alias("t")).orderBy("i").collect()]
    assert tens[5:] == [0.0, 0.0, 0.0]
    huge = [r.t for r in frame.select("i", truncated(F.col("v"), 400).alias("t")).orderBy("i").collect()]
    assert huge[6:] == [-2.57, 2.57]


def test_nan_and_signed_zero_are_equal_to_themselves(frame):
    nan = float("nan")
    assert diffs(*doubles(frame, (nan, nan), (0.0, -0.0), (nan, 1.0))) == 1
    assert diffs(*doubles(frame, (nan, nan), (0.0, -0.0), (nan, 1.0)), Precision(1)) == 1


def test_default_precision_and_overrides(frame):
    schema = "id int, price double, weight double, label string"
    a = frame(schema, (1, 10.1, 1.111, "x"), (2, 20.1, 2.222, "y"))
    b = frame(schema, (1, 10.9, 1.122, "x"), (2, 21.1, 2.233, "z"))
    found = stats_of(compare(a, b, pk_columns=["id"], tolerance=0, column_tolerances={"weight": Precision(2)}))
    assert found == {"price": (1, 1), "weight": (2, 0), "label": (1, 0)}


def test_seconds_bound_is_included(frame):
    schema = "id int, ts timestamp_ntz"
    gaps = [3.0, 5.0, 5.000001, 10.0]
    a = frame(schema, *[(i, T0) for i in range(4)], (4, None), (5, None))
    b = frame(schema, *[(i, T0 + timedelta(seconds=g)) for i, g in enumerate(gaps)], (4, None), (5, T0))
    assert diffs(a, b, Seconds(5), "ts") == 3
    assert diffs(b, a, Seconds(5), "ts") == 3
    assert diffs(a, b, Seconds(5), "ts", pair_budget=0.0) == 3
    assert diffs(a, b, Seconds(0), "ts") == 5
    assert diffs(a, b, Seconds(1e300), "ts") == 1
    assert diffs(a, b, Seconds(1e300), "ts", pair_budget=0.0) == 1


def test_seconds_on_zoned_timestamps(frame):
    schema = "id int, ts timestamp"
    a, b = frame(schema, (1, T0)), frame(schema, (1, T0 + timedelta(milliseconds=1500)))
    for budget in (0.0, 10.0):
        assert diffs(a, b, Seconds(1.5), "ts", pair_budget=budget) == 0
        assert diffs(a, b, Seconds(1.4), "ts", pair_budget=budget) == 1


def test_seconds_where_the_clock_goes_back(spark, frame):
    """05:30Z and 06:30Z show the same local time in New York on that day, and are an hour apart all the same."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        at = spark.range(1).selectExpr("1 AS id", "timestamp_seconds(1730611800) AS ts")
        later = spark.range(1).selectExpr("1 AS id", "timestamp_seconds(1730611800 + 3600) AS ts")
        for budget in (0.0, 10.0):
            assert diffs(at, later, Seconds(5), "ts", pair_budget=budget) == 1
            assert diffs(at, later, Seconds(3599), "ts", pair_budget=budget) == 1
            assert diffs(at, later, Seconds(3600), "ts", pair_budget=budget) == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_seconds_do_not_depend_on_the_session_zone(spark, frame):
    schema = "id int, ts timestamp_ntz"
    # An hour that daylight saving skips in Berlin.
    a, b = frame(schema, (1, datetime(2024, 3, 31, 1, 59, 59))), frame(schema, (1, datetime(2024, 3, 31, 3, 0, 0)))
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        for budget in (0.0, 10.0):
            assert diffs(a, b, Seconds(3600), "ts", pair_budget=budget) == 1
            assert diffs(a, b, Seconds(3601), "ts", pair_budget=budget) == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_string_tolerances(frame):
    a, b = strings(frame, ("Alice", "ALICE"), ("Bob", "Bobby"))
    assert diffs(a, b, CaseInsensitive(), "name") == 1
    a, b = strings(frame, (" Alice ", "Alice"), ("Bob", "B ob"))
    assert diffs(a, b, Whitespace(), "name") == 1
    a, b = strings(frame, ("  ALICE ", "alice"), ("Bob", " bob"))
    assert diffs(a, b, CaseInsensitiveWhitespace(), "name") == 0


def test_whitespace_means_space_separators(frame):
    a, b = strings(frame, ("x", " 　x "), ("x", "x\t"), ("x", "\nx"), (None, " "))
    assert diffs(a, b, Whitespace(), "name") == 3


def test_unfitting_tolerance_compares_exactly(frame):
    a, b = strings(frame, ("1.2345", "1.2345"), ("1.2345", "1.2346"))
    assert diffs(a, b, Precision(3), "name") == 1
    assert diffs(a, b, Seconds(3), "name") == 1
    a, b = doubles(frame, (1.0, 1.0), (1.0, 2.0))
    for tolerance in (CaseInsensitive(), Whitespace(), Seconds(5)):
        assert diffs(a, b, tolerance) == 1


def test_unknown_tolerance_column_is_ignored(frame):
    a, b = doubles(frame, (1.0, 2.0))
    found = compare(a, b, pk_columns=["id"], column_tolerances={"absent": Precision(1)})
    assert stats_of(found) == {"val": (1, 0)}


@pytest.mark.parametrize("seconds", [-1.0, float("nan"), float("inf")])
def test_seconds_must_be_finite_and_not_negative(seconds):
    with pytest.raises(ValueError, match="Seconds"):
        DiffConfig(pk_columns=["id"], column_tolerances={"ts": Seconds(seconds)})


def test_minor_rows(frame):
    schema = "id int, amount double, status string"
    a = frame(schema, (1, 100.1, "x"), (2, 200.0, "y"), (3, 300.0, "z"))
    b = frame(schema, (1, 100.9, "x"), (2, 250.0, "y"), (3, 300.0, "z"))
    found = overview_of(compare(a, b, pk_columns=["id"], tolerance=0))
    assert (found["rows_with_diffs"], found["rows_minor"], found["rows_identical"]) == (1, 1, 1)


def test_row_with_real_and_minor_difference_counts_as_differing(frame):
    schema = "id int, amount double, status string"
    a, b = frame(schema, (1, 100.1, "x")), frame(schema, (1, 100.9, "y"))
    found = overview_of(compare(a, b, pk_columns=["id"], tolerance=0))
    assert (found["rows_with_diffs"], found["rows_minor"], found["rows_identical"]) == (1, 0, 0)


def test_nested_and_map_columns_compare_exactly(frame):
    schema = "id int, m map<string,int>, l array<int>, s struct<x:int>, d binary"
    a = frame(schema, (1, {"x": 1, "y": 2}, [1, 2], (1,), b"a"), (2, {"x": 1}, [1], (1,), b"a"), (3, None, None, None, None))
    b = frame(schema, (1, {"y": 2, "x": 1}, [1, 2], (1,), b"a"), (2, {"x": 2}, [2], (2,), b"b"), (3, None, None, None, None))
    expected = {"m": (1, 0), "l": (1, 0), "s": (1, 0), "d": (1, 0)}
    assert stats_of(compare(a, b, pk_columns=["id"])) == expected
    assert stats_of(compare(a, b, pk_columns=["id"], pair_budget=0.0)) == expected
    assert compare(a, b, pk_columns=["id"]).page("all").rows.count() == 3


def test_maps_and_variants_at_any_depth(spark):
    a = spark.sql("""SELECT 1 AS id, array(map('x', 1, 'y', 2)) AS l, map('p', map('x', 1, 'y', 2)) AS m,
        named_struct('f', map(1, 'a', 2, 'b')) AS s, parse_json('{"a": 1, "b": [1, {"c": 2, "d": 3}]}') AS v
        UNION ALL SELECT 2, array(map('x', 1)), map('p', map('x', 1)), named_struct('f', map(1, 'a')), parse_json('{"a": 1}')
        UNION ALL SELECT 3, NULL, NULL, NULL, NULL""")
    b = spark.sql("""SELECT 1 AS id, array(map('y', 2, 'x', 1)) AS l, map('p', map('y', 2, 'x', 1)) AS m,
        named_struct('f', map(2, 'b', 1, 'a')) AS s, parse_json('{"b": [1, {"d": 3, "c": 2}], "a": 1}') AS v
        UNION ALL SELECT 2, array(map('x', 2)), map('p', map('x', 2)), named_struct('f', map(1, 'b')), parse_json('{"a": 2}')
        UNION ALL SELECT 3, NULL, NULL, NULL, NULL""")
    expected = {c: (1, 0) for c in ("l", "m", "s", "v")}
    for budget in (1.0, 0.0):
        assert stats_of(compare(a, b, pk_columns=["id"], pair_budget=budget)) == expected
    assert compare(a, b, pk_columns=["id"]).rows("diffs").count() == 1


def test_wide_pair(spark):
    """A pair of 31 columns of three types: 48 shared ids, two more on each side, 47 rows with 213 differing cells."""
    rng = random.Random(1)
    places = {(1 + i, c) for i in range(47) for c in [1 + i % 30]}
    while len(places) < 213:
        places.add((rng.randrange(1, 48), rng.randrange(1, 31)))
    kinds = ["string", "bigint", "double"]

    def cell(i: int, c: int, changed: bool):
        return [f"val_{i}_{c}" + "x" * changed, i * 1000 + c + changed, i + c / 100 + changed][c % 3]

    schema = "id bigint, " + ", ".join(f"col_{c:02} {kinds[c % 3]}" for c in range(1, 31))
    a = spark.createDataFrame([(i, *[cell(i, c, False) for c in range(1, 31)]) for i in range(1, 51)], schema)
    b = spark.createDataFrame([(i, *[cell(i, c, (i, c) in places) for c in range(1, 31)]) for i in [*range(1, 49), 51, 52]], schema)
    comparison = compare(a, b, pk_columns=["id"])
    found = overview_of(comparison)
    assert [found[x] for x in ("total_compared", "exclusive_a", "exclusive_b", "rows_with_diffs", "rows_identical")] == [48, 2, 2, 47, 1]
    assert sum(d for d, _ in stats_of(comparison).values()) == 213
    assert comparison.cell_changes().count() == 213


def test_near_pairs_and_rows_against_all_pairs(spark):
    rng = random.Random(6)
    values = [None, -62135596800000000, -7, -1, 0, 1, 5, 6, 12, 1000, 253402300799999999]
    rows = [(rng.choice(["k", "l", None]), rng.choice(values), rng.choice(values), rng.randrange(3), rng.randrange(3)) for _ in range(120)]
    df = spark.createDataFrame(rows, "k string, t long, u long, in_a long, in_b long")

    def near(x, y, reach):
        return x is None and y is None or None not in (x, y) and abs(x - y) <= reach

    for r, q in ((0, 3), (1, 0), (6, 1000), (640_000_000_000_000_000, 5)):
        pairs = [(x, y) for x in rows for y in rows if x[0] == y[0] and near(x[1], y[1], r)]
        assert near_pairs(df, ["k"], "t", r).first().n == sum(x[3] * y[4] for x, y in pairs)
        expected = sum(x[3] * y[4] for x, y in pairs if near(x[2], y[2], q))
        assert near_rows(df, ["k"], {"t": r, "u": q}).first().n == expected


def test_stretches_stay_even_whatever_the_places(spark):
    """Most places within minutes and a few thousands of years away, many rows at one place: no stretch holds over twice the mean."""
    near = spark.range(20_000).select((F.lit(1_700_000_000_000_000) + F.xxhash64("id") % 60_000_000).alias("p"))
    far = spark.createDataFrame([(-62135596800000000,), (253402300799000000,)] * 3, "p bigint")
    rows = near.unionAll(far)
    bounds = ranges.quantile_bounds(rows, "p", 500)
    sizes = [r["count"] for r in rows.groupBy(ranges.stretch_of("p", bounds).alias("s")).count().collect()]
    assert len(sizes) == 41 and max(sizes) <= 2 * 20_006 / 41
    assert bounds == sorted(bounds)
    cut = spark.range(-5, 25).select("id", ranges.stretch_of("id", [0, 3, 3, 19]).alias("s")).collect()
    assert all(r.s == sum(b < r.id for b in [0, 3, 3, 19]) for r in cut)


def test_wide_distances_on_one_key_do_not_meet_in_pairs(spark):
    """Two distances that make most of 9 million pairs near: no operator makes more than some rows for each given row."""
    at = lambda salt: F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.xxhash64("id", F.lit(salt)) % 3_600_000_000)
    a = spark.range(3000).select(F.lit(1).alias("k"), at(1).alias("t"), at(2).alias("u"))
    b = spark.range(3000).select(F.lit(1).alias("k"), at(3).alias("t"), at(4).alias("u"))
    found = compare(a, b, pk_columns=["k"], column_tolerances={"t": Seconds(1800), "u": Seconds(900)}).overview().first()
    times = lambda df: [(r.t.timestamp(), r.u.timestamp()) for r in df.collect()]
    x, y = np.array(times(a)), np.array(times(b))
    near = sum(int(((np.abs(y[:, 0] - t) <= 1800) & (np.abs(y[:, 1] - u) <= 900)).sum()) for t, u in x)
    assert (found.total_compared, found.rows_with_diffs) == (9_000_000, 9_000_000 - near)


def test_distances_grow_no_faster_than_columns(spark):
    """Five distance columns on a key of two values: no explosion, and the same answers as for one."""
    moment = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    a = spark.range(2000).select((F.col("id") % 2).alias("k"), *[moment.alias(f"t{i}") for i in range(5)])
    b = a.withColumns({f"t{i}": F.col(f"t{i}") + F.expr("INTERVAL '1' SECOND") for i in range(5)})
    for n in (1, 2, 5):
        names = [f"t{i}" for i in range(n)]
        comparison = compare(a.select("k", *names), b.select("k", *names), pk_columns=["k"], column_tolerances={c: Seconds(3) for c in names}, pair_budget=0.0)
        # Times of a key lie two seconds apart; within 3 s of t + 1 are t - 2, t, t + 2 and t + 4.
        assert overview_of(comparison)["rows_minor"] == sum(sum(0 <= i + d < 1000 for d in (-2, -1, 0, 1)) for i in range(1000)) * 2


def test_displayed_precision(spark):
    frame = spark.createDataFrame([(1.999,), (-0.18,), (12345678.0,)], "v double")
    assert [r.v for r in frame.select(displayed(F.col("v"), 1).alias("v")).collect()] == ["1.9", "-0.1", "12345678.0"]


def test_configuration_from_json_form():
    config = DiffConfig.from_dict(
        {
            "pk_columns": ["id"],
            "pk_expression": None,
            "tolerance": 2,
            "column_tolerances": {
                "a": {"mode": "precision", "precision": 1},
                "b": {"mode": "seconds", "seconds": 2.5},
                "c": {"mode": "case_insensitive"},
                "d": {"mode": "whitespace"},
                "e": {"mode": "case_insensitive_whitespace"},
            },
            "ignored_columns": None,
            "where_clause": " ",
        }
    )
    assert config.column_tolerances == {
        "a": Precision(1),
        "b": Seconds(2.5),
        "c": CaseInsensitive(),
        "d": Whitespace(),
        "e": CaseInsensitiveWhitespace(),
    }
    assert config.row_filter is None and config.tolerance == 2
    with pytest.raises(ValueError, match="Unknown tolerance"):
        tolerance_from_dict({"mode": "fuzzy"})
