"""Metric tables, their order, top lists and pages."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicketworks.functions import best_first
from wicketworks.schema import PAGE_SIZE, TOP_SIZE, Discipline


def metric_table(table: DataFrame, discipline: Discipline, metric: str) -> DataFrame:
    """The columns shown for a metric, largest metric first."""
    name = discipline.metric(metric)
    shown = table.select(discipline.player, *discipline.presets[name])
    return shown.orderBy(*best_first(name, discipline.player))


def top(table: DataFrame, discipline: Discipline, metric: str, size: int = TOP_SIZE) -> DataFrame:
    """Player and metric of the first rows; ties are cut by name."""
    name = discipline.metric(metric)
    pair = table.select(discipline.player, name)
    return pair.orderBy(*best_first(name, discipline.player)).limit(size)


def page_after(
    table: DataFrame,
    discipline: Discipline,
    metric: str,
    last_value: float | None,
    last_player: str | None,
    size: int = PAGE_SIZE,
) -> DataFrame:
    """The page after the row of ``last_player`` and ``last_value``, the last one of the page before.

    Whatever the page, each task keeps ``size`` rows of those that follow; an offset keeps all rows of the pages before it
    as well. ``last_value`` is the value shown, infinity and NaN included; NaN and missing values are the same place, the
    end of the order, where rows go by name. A missing name comes first among equals.
    """
    name = discipline.metric(metric)
    value, player = F.col(name).cast("double"), F.col(discipline.player)
    placed = F.when(~F.isnan(value), value)
    later_name = player.isNotNull() if last_player is None else player > last_player
    if last_value is None or math.isnan(last_value):
        follows = placed.isNull() & later_name
    else:
        follows = placed.isNull() | (placed < last_value) | ((placed == last_value) & later_name)
    return metric_table(table.where(F.coalesce(follows, F.lit(False))), discipline, metric).limit(size)


def page(ranked: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """Page ``number``, counted from 1, of an ordered table."""
    return ranked.offset(size * (number - 1)).limit(size)
