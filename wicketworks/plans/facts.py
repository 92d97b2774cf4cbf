"""Balls with their match, without the players that fall short of the volume of a season.

The balls are read twice, once for two columns. Both times they meet nothing but matches: the players to leave out
are listed per match, and that list travels with the match. No ball is moved by player, however many one of them has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketworks.operators.combine import combine
from wicketworks.operators.qualify import drop_listed, listed_per_match, match_volume, short_in_season
from wicketworks.schema import BALLS_PER_OVER, MAX_EXCLUDED_BALLS_FACED, MAX_EXCLUDED_OVERS


def bowling_facts(
    deliveries: DataFrame, matches: DataFrame, *, max_excluded_overs: float = MAX_EXCLUDED_OVERS, store: str | None = None
) -> DataFrame:
    """Balls of the bowlers above the volume threshold, with the columns of their match.

    With ``store``, the matches and their lists are written there and read back: their size is then
    known when the join is planned, so a small table is broadcast and the balls stay where they are.
    Without it Spark has an upper bound only, and moves the balls once, by match.
    """
    overs = F.col("season_balls") / F.lit(float(BALLS_PER_OVER))
    return _facts(deliveries, matches, "bowler", overs <= max_excluded_overs, store)


def batting_facts(
    deliveries: DataFrame, matches: DataFrame, *, max_excluded_balls: int = MAX_EXCLUDED_BALLS_FACED, store: str | None = None
) -> DataFrame:
    """Balls of the strikers above the volume threshold, with the columns of their match; ``store`` as for bowling."""
    return _facts(deliveries, matches, "batsman", F.col("season_balls") <= max_excluded_balls, store)


def _facts(deliveries: DataFrame, matches: DataFrame, player: str, falls_short: Column, store: str | None) -> DataFrame:
    short = short_in_season(match_volume(deliveries, player), matches, player, falls_short)
    listed = listed_per_match(short, player).withColumnRenamed("match_id", "id")
    games = matches.join(listed, "id", "left")
    if store:
        games.write.mode("overwrite").parquet(store)
        games = matches.sparkSession.read.parquet(store)
    return drop_listed(combine(deliveries, games), player)
