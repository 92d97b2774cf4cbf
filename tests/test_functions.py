import math
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from balls import dicts, one
from wicketworks.functions import (
    best_first,
    clear_infinite,
    clear_nan,
    fill_missing,
    guarded_ratio,
    ieee_ratio,
    in_stage,
    natural_full_join,
    null_safe_join,
    paste_key,
    round_numeric,
    strict_sum,
    tenths_sum,
    with_stage,
)
from wicketworks.schema import STAGES

INF, NAN = float("inf"), float("nan")


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


def test_strict_sum_is_null_with_one_null_and_composes(spark):
    df = spark.createDataFrame(
        [("a", 1, 2), ("a", 1, None), ("a", 2, 3), ("b", 1, 4), ("b", 2, 5)], "k string, m int, x int"
    )
    direct = {r["k"]: r["s"] for r in dicts(df.groupBy("k").agg(strict_sum("x").alias("s")))}
    twice = df.groupBy("k", "m").agg(strict_sum("x").alias("x")).groupBy("k").agg(strict_sum("x").alias("s"))
    assert direct == {"a": None, "b": 9}
    assert {r["k"]: r["s"] for r in dicts(twice)} == direct


def test_ratios(spark):
    df = spark.createDataFrame(
        [(10, 4), (10, 0), (0, 0), (-3, 0), (None, 4), (7, None)], "n int, d int"
    ).select(ieee_ratio(F.col("n"), F.col("d")).alias("i"), guarded_ratio(F.col("n"), F.col("d")).alias("g"))
    rows = dicts(df)
    assert all(same(r["i"], e) for r, e in zip(rows, [2.5, INF, NAN, -INF, None, None]))
    assert [r["g"] for r in rows] == [2.5, 0.0, 0.0, 0.0, None, None]


def test_rounding_goes_to_the_nearest_tenth_of_the_stored_number(spark):
    ties = {6.25: 6.2, 6.75: 6.8, 0.25: 0.2, -6.25: -6.2}
    beside = {53 / 40 * 6: 7.9, 28.05: 28.1, 40.15: 40.1, 15.05: 15.1, -28.05: -28.1}
    expected = {**ties, **beside, INF: INF, -INF: -INF}
    df = spark.createDataFrame([(x, 3) for x in [*expected, NAN, None]], "x double, n bigint")
    rows = dicts(round_numeric(df))
    assert all(same(r["x"], e) for r, e in zip(rows, [*expected.values(), NAN, None]))
    assert {r["n"] for r in rows} == {3}


def test_rounding_agrees_with_decimal_arithmetic(spark):
    values = [a / b * c for a in range(300) for b in range(1, 40) for c in (1, 6, 100)] + [n / 20 for n in range(4000)]
    plain = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    got = [r["x"] for r in round_numeric(plain).orderBy("i").collect()]
    assert got == [float(Decimal(x).quantize(Decimal("0.1"), ROUND_HALF_EVEN)) for x in values]


def test_tenths_are_summed_exactly(spark):
    df = spark.range(0, 3, 1, 1).select(F.lit(0.1).alias("x"))
    sums = one(df.agg(tenths_sum("x").alias("exact"), F.sum("x").alias("plain")))
    assert sums["exact"] == 0.3 and sums["plain"] != 0.3


def test_missing_values(spark):
    df = spark.createDataFrame([(None, None, NAN), ("p", 2, INF)], "name string, n int, x double")
    filled = dicts(fill_missing(df))
    assert filled == [{"name": None, "n": 0, "x": 0.0}, {"name": "p", "n": 2, "x": INF}]
    cleared = dicts(clear_nan(clear_infinite(df)))
    assert [r["x"] for r in cleared] == [0.0, 0.0]


def test_order_puts_infinity_first_nan_last_and_ties_by_name(spark):
    df = spark.createDataFrame(
        [("d", NAN), ("b", 2.0), ("e", None), ("a", 2.0), ("c", INF)], "p string, x double"
    )
    assert [r["p"] for r in dicts(df.orderBy(*best_first("x", "p")))] == ["c", "a", "b", "d", "e"]


def test_paste_key(spark):
    df = spark.createDataFrame([("A", 2008), (None, 2008), ("A", None)], "p string, s int")
    assert [r["k"] for r in dicts(df.select(paste_key("p", "s").alias("k")))] == ["A2008", "NA2008", "ANA"]


def test_null_keys_match_each_other(spark):
    left = spark.createDataFrame([("a", 1, 10), (None, 1, 20), ("b", None, 30)], "p string, s int, x int")
    right = spark.createDataFrame([(None, 1), ("b", None)], "p string, s int")
    assert [r["x"] for r in dicts(null_safe_join(left, right, ["p", "s"], "left_anti"))] == [10]
    # Also of a table with a part of itself.
    part = left.where("x > 10").select("p", "s")
    assert [r["x"] for r in dicts(null_safe_join(left, part, ["p", "s"], "left_anti"))] == [10]


def test_natural_full_join(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([(None, 3), ("c", 4)], "k string, y int")
    rows = {(r["k"], r["x"], r["y"]) for r in dicts(natural_full_join(left, right))}
    assert rows == {("a", 1, None), (None, 2, 3), ("c", None, 4)}
    with pytest.raises(ValueError):
        natural_full_join(left, right.select(F.col("y").alias("z")))


def test_stage_bounds(spark):
    df = spark.createDataFrame([(o,) for o in (1, 6, 7, 15, 16, 20, 25, None)], "over int")
    tags = {r["over"]: r["stage"] for r in dicts(with_stage(df))}
    assert tags == {
        1: "Powerplay", 6: "Powerplay", 7: "Middle", 15: "Middle", 16: "Death", 20: "Death", 25: "Death",
    }
    for stage in STAGES:
        assert {r["over"] for r in dicts(df.where(in_stage(stage)))} == {o for o in tags if tags[o] == stage}
