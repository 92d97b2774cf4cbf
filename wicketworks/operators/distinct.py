"""Distinct values: choice lists, and values by order of first appearance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicketworks.schema import CREDITED_POSITIONS


def seasons(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    """Seasons with at least one ball. Reads nothing of the facts but the match ids."""
    played = deliveries.select(F.col("match_id").alias("id")).distinct()
    return matches.join(played, "id", "left_semi").select("season").distinct().orderBy("season")


def player_choices(mart: DataFrame, player: str = "bowler", *, repeats: bool = True) -> DataFrame:
    """Players of a mart as text, with a row for every mart row or only once each."""
    names = mart.select(F.col(player).cast("string").alias(player))
    return names if repeats else names.distinct().orderBy(player)


def first_seen(df: DataFrame, column: str, *order: Column) -> DataFrame:
    """Distinct values with the place they were first seen at, in that order.

    A null is a value too. Rows are ordered by ``order``, then by the value.
    """
    place = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    return df.groupBy(column).agg(F.min(place).alias("first_seen")).orderBy("first_seen", column)


def pick_positions(values: DataFrame, positions: Sequence[int] = CREDITED_POSITIONS) -> DataFrame:
    """Values at 1-based places of ``first_seen``.

    Only the leading values are numbered, as many as the last place asked for.
    """
    column = values.columns[0]
    leading = values.orderBy("first_seen", column).limit(max(positions))
    numbered = leading.withColumn(
        "position", F.row_number().over(Window.orderBy("first_seen", column))
    )
    return numbered.where(F.col("position").isin(*positions))


def values_at(df: DataFrame, column: str, *order: Column, positions: Sequence[int] = CREDITED_POSITIONS) -> list:
    """The values at these places, as a list of that length at most.

    Gives the credited dismissal kinds of a file whose order is known, to be passed as ``kinds``.
    """
    picked = pick_positions(first_seen(df, column, *order), positions)
    return [row[column] for row in picked.orderBy("position").collect()]
