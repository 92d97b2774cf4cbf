"""Sums, ratios, rounding and missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")
NAN = float("nan")


def rows() -> Column:
    """Number of rows of a group."""
    return F.count(F.lit(1))


def strict_sum(column: str) -> Column:
    """A sum that is null as soon as one value of the group is null.

    Strict sums compose: a strict sum of strict sums is the strict sum over all rows.
    """
    value = F.col(column)
    return F.when(F.count(value) == rows(), F.sum(value))


def tenths_sum(column: str) -> Column:
    """Exact sum of doubles that hold one decimal, whatever order the rows come in."""
    return F.sum(F.rint(F.col(column) * 10).cast("long")) / F.lit(10.0)


def guarded_ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, 0 where the bottom is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom)


def ieee_ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` where x/0 is an infinity and 0/0 is NaN, also in ANSI mode."""
    top, bottom = top.cast("double"), bottom.cast("double")
    by_zero = (
        F.when(F.isnan(top) | (top == 0), F.lit(NAN))
        .when(top > 0, F.lit(INFINITY))
        .when(top < 0, F.lit(-INFINITY))
    )
    return F.when(bottom != 0, top / bottom).when(bottom == 0, by_zero)


def round_one(value: Column) -> Column:
    """The tenth nearest to the number as it is stored, ties to even.

    The product with ten may be rounded onto a tie that the number itself is not on. What the product lost
    is exact as the error of a sum, and says on which side of the tie the number is.
    """
    most, rest = value * 8, value * 2
    product = most + rest
    lost = rest - (product - most)
    whole = F.rint(product)
    beyond = product - whole
    nearest = (
        F.when((beyond == 0.5) & (lost > 0), whole + 1)
        .when((beyond == -0.5) & (lost < 0), whole - 1)
        .otherwise(whole)
    )
    return nearest / 10


def _columns_of(df: DataFrame, kind: type[T.DataType]) -> list[str]:
    return [field.name for field in df.schema.fields if isinstance(field.dataType, kind)]


def round_numeric(df: DataFrame) -> DataFrame:
    """Every numeric column to one decimal; whole-number types already are."""
    return df.withColumns({name: round_one(F.col(name)) for name in _columns_of(df, T.FractionalType)})


def fill_missing(df: DataFrame) -> DataFrame:
    """Null and NaN to 0 in every numeric column, key columns too."""
    return df.na.fill(0)


def clear_infinite(df: DataFrame) -> DataFrame:
    """Positive infinity to 0 in every floating-point column."""
    return df.withColumns(
        {
            name: F.when(F.col(name) == F.lit(INFINITY), F.lit(0.0)).otherwise(F.col(name))
            for name in _columns_of(df, T.FractionalType)
        }
    )


def clear_nan(df: DataFrame) -> DataFrame:
    """NaN to 0 in every floating-point column."""
    return df.withColumns(
        {
            name: F.when(F.isnan(name), F.lit(0.0)).otherwise(F.col(name))
            for name in _columns_of(df, T.FractionalType)
        }
    )
