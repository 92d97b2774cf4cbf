"""Roll-ups of a mart over innings, stages and seasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketworks.functions import ieee_ratio, round_numeric, tenths_sum
from wicketworks.schema import (
    DEFAULT_INNING,
    DEFAULT_STAGE,
    INNING_CHOICES,
    STAGE_CHOICES,
    STAGES,
    Discipline,
)


def roll_up(
    table: DataFrame, discipline: Discipline, keys: Sequence[str], without: Sequence[str] = (), *more: Column
) -> DataFrame:
    """Add the measures up per key and compute the ratios anew, not rounded. ``more`` are aggregates beside them.

    Ratios without a denominator stay infinite or NaN.
    """

    def total(name: str):
        if name in discipline.maxima:
            return F.max(name).alias(name)
        if name in discipline.tenths:
            return tenths_sum(name).alias(name)
        return F.sum(name).alias(name)

    kept = [m for m in discipline.measures if m not in without]
    totals = table.groupBy(*keys).agg(*(total(m) for m in kept), *more)
    return totals.withColumns(
        {r.name: ieee_ratio(F.col(r.top), F.col(r.bottom)) * r.times for r in discipline.ratios}
    )


def select_inning(
    table: DataFrame, discipline: Discipline, inning: str | int = DEFAULT_INNING
) -> DataFrame:
    """Inning 1 or 2 as it is, anything else all innings added up by player and stage."""
    number = INNING_CHOICES.get(str(inning))
    if number is not None:
        return table.where(F.col("inning") == number)
    return round_numeric(roll_up(table, discipline, [discipline.player, "stage"]))


def select_stage(table: DataFrame, discipline: Discipline, stage: str = DEFAULT_STAGE) -> DataFrame:
    """One stage as it is, anything else all stages added up by player.

    Runs on the rounded values ``select_inning`` gives, and rounds again.
    """
    name = stage if stage in STAGES else STAGE_CHOICES.get(stage)
    if name is not None:
        return table.where(F.col("stage") == name)
    return round_numeric(roll_up(table, discipline, [discipline.player], discipline.inning_only))
