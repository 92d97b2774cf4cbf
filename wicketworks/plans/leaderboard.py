"""Ranked tables and top lists for one request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicketworks.operators.lattice import from_lattice
from wicketworks.operators.ranking import metric_table, top
from wicketworks.operators.rollup import select_inning, select_stage
from wicketworks.schema import DEFAULT_INNING, DEFAULT_SEASON, DEFAULT_STAGE, Discipline


def selection(
    mart: DataFrame,
    discipline: Discipline,
    season: int | str = DEFAULT_SEASON,
    inning: str | int = DEFAULT_INNING,
    stage: str = DEFAULT_STAGE,
) -> DataFrame:
    """All measures of one season for the inning and stage asked for, from a mart or from its lattice."""
    if "stage_choice" in mart.columns:
        return from_lattice(mart, discipline, season, inning, stage)
    year = mart.where(F.col("season") == int(season))
    return select_stage(select_inning(year, discipline, inning), discipline, stage)


def leaderboard(
    mart: DataFrame,
    discipline: Discipline,
    season: int | str = DEFAULT_SEASON,
    inning: str | int = DEFAULT_INNING,
    stage: str = DEFAULT_STAGE,
    metric: str | None = None,
) -> DataFrame:
    """The columns shown for a metric, ranked by it."""
    chosen = selection(mart, discipline, season, inning, stage)
    return metric_table(chosen, discipline, metric or discipline.default_metric)


def top_players(
    mart: DataFrame,
    discipline: Discipline,
    season: int | str = DEFAULT_SEASON,
    inning: str | int = DEFAULT_INNING,
    stage: str = DEFAULT_STAGE,
    metric: str | None = None,
) -> DataFrame:
    """The six players with the largest metric."""
    chosen = selection(mart, discipline, season, inning, stage)
    return top(chosen, discipline, metric or discipline.default_metric)
