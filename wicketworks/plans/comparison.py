"""Two bowlers season by season."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicketworks.operators.rollup import roll_up
from wicketworks.schema import BOWLING, DEFAULT_BOWLERS, DEFAULT_PARAMETERS, Discipline


def compare_seasons(
    mart: DataFrame, player1: str, player2: str, discipline: Discipline = BOWLING
) -> DataFrame:
    """All measures of two players per season, not rounded; the season is a category."""
    seasons = roll_up(mart, discipline, [discipline.player, "season"])
    chosen = seasons.where(F.col(discipline.player).isin(player1, player2))
    return chosen.withColumn("season", F.col("season").cast("string"))


def compare_players(
    mart: DataFrame,
    player1: str = DEFAULT_BOWLERS[0],
    player2: str = DEFAULT_BOWLERS[1],
    parameter1: str = DEFAULT_PARAMETERS[0],
    parameter2: str = DEFAULT_PARAMETERS[1],
    discipline: Discipline = BOWLING,
) -> DataFrame:
    """Two measures of two players per season; a measure asked for twice is one column."""
    columns = dict.fromkeys([discipline.player, "season", parameter1, parameter2])
    return compare_seasons(mart, player1, player2, discipline).select(*columns)
