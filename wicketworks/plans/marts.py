"""The two marts, from balls and matches.

A ball row never crosses an exchange. The balls are first added up within a match, where the map
tasks already combine most of them, and the season is joined to those totals. Both sides of that
join grow with the data, so there is no broadcast hint: Spark compares the measured size with
``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and merges, splitting a skewed match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wicketworks.functions import null_safe_join, stage_of
from wicketworks.operators import batting, bowling
from wicketworks.operators.combine import attach_season, of_season
from wicketworks.operators.qualify import match_volume
from wicketworks.schema import (
    BALLS_PER_OVER,
    BATTING_MART,
    BOWLING_MART,
    CREDITED_DISMISSALS,
    MAX_EXCLUDED_BALLS_FACED,
    MAX_EXCLUDED_OVERS,
)

BOWLING_KEYS = ("bowler", "inning", "season", "stage")
BATTING_KEYS = ("batsman", "inning", "season", "stage")


def bowling_mart(
    deliveries: DataFrame,
    matches: DataFrame,
    *,
    max_excluded_overs: float = MAX_EXCLUDED_OVERS,
    kinds: Sequence[str] = CREDITED_DISMISSALS,
    season: int | None = None,
) -> DataFrame:
    """Bowling per player, inning, season and stage, of the bowlers above the volume threshold.

    With ``season`` the mart of that season only, from its balls only.
    """
    totals = bowling_totals(deliveries, matches, max_excluded_overs=max_excluded_overs, kinds=kinds, season=season)
    return finished_bowling(totals)


def finished_bowling(totals: DataFrame) -> DataFrame:
    """The mart of ``bowling_totals``."""
    return bowling.finish_bowling(totals, BOWLING_KEYS).select(*BOWLING_MART.names)


def bowling_totals(
    deliveries: DataFrame,
    matches: DataFrame,
    *,
    max_excluded_overs: float = MAX_EXCLUDED_OVERS,
    kinds: Sequence[str] = CREDITED_DISMISSALS,
    season: int | None = None,
) -> DataFrame:
    """What the bowling mart, the merged measures and the union of the stages are made of.

    One scan. The threshold is tested on the finished totals, where a bowler-season has one row per inning and stage.
    """
    if season is not None:
        deliveries, matches = of_season(deliveries, matches, season)
    overs = bowling.over_totals(deliveries, ["bowler", "inning"], kinds)
    return bowling_totals_of(overs, matches, max_excluded_overs)


def bowling_totals_of(overs: DataFrame, matches: DataFrame, max_excluded_overs: float) -> DataFrame:
    """The same from one row per bowler, inning, match and over."""
    staged = attach_season(overs, matches).withColumn("stage", stage_of())
    totals = bowling.player_totals(bowling.match_totals(staged, BOWLING_KEYS), BOWLING_KEYS)
    counted = _with_season_balls(totals, "balls", "bowler")
    kept = counted.where(F.col("season_balls") > max_excluded_overs * BALLS_PER_OVER)
    return _in_a_stage(kept)


def batting_mart(
    deliveries: DataFrame,
    matches: DataFrame,
    *,
    max_excluded_balls: int = MAX_EXCLUDED_BALLS_FACED,
    excluded: DataFrame | None = None,
    season: int | None = None,
) -> DataFrame:
    """Batting per player, season, inning and stage, of the batsmen above the volume threshold.

    With ``season`` the mart of that season only, from its balls only. ``excluded`` as for ``batting_totals``.
    """
    totals = batting_totals(
        deliveries, matches, max_excluded_balls=max_excluded_balls, excluded=excluded, season=season
    )
    return finished_batting(totals)


def finished_batting(totals: DataFrame) -> DataFrame:
    """The mart of ``batting_totals``."""
    return batting.finish_batting(batting.with_not_outs(totals), BATTING_KEYS).select(*BATTING_MART.names)


def batting_totals(
    deliveries: DataFrame,
    matches: DataFrame,
    *,
    max_excluded_balls: int = MAX_EXCLUDED_BALLS_FACED,
    excluded: DataFrame | None = None,
    season: int | None = None,
) -> DataFrame:
    """What the batting mart, the merged measures and the union of the stages are made of.

    Two scans: one of the match and striker columns for the list of excluded strikers, one for the
    partnerships, which need that list before they are split into players. ``excluded`` may be that
    list as stored: its size is then known when the join is planned, and a small one is broadcast
    without the partnerships being moved.
    """
    if season is not None:
        deliveries, matches = of_season(deliveries, matches, season)
    staged = deliveries.withColumn("stage", stage_of())
    partnerships = batting.partnership_totals(staged, ["inning", "stage"])
    if excluded is None:
        excluded = excluded_batsmen(deliveries, matches, max_excluded_balls)
    return batting_totals_of(partnerships, matches, excluded, max_excluded_balls)


def batting_totals_of(
    partnerships: DataFrame, matches: DataFrame, excluded: DataFrame, max_excluded_balls: int
) -> DataFrame:
    """The same from one row per match, inning, stage, striker, non-striker and dismissed player."""
    flagged = null_safe_join(
        attach_season(partnerships, matches), excluded.withColumn("excluded", F.lit(True)), ["batsman", "season"], "left"
    )
    roles = batting.player_roles(flagged, BATTING_KEYS, F.col("excluded").isNull())
    totals = batting.player_totals(batting.player_match_totals(roles, BATTING_KEYS), BATTING_KEYS)
    counted = _with_season_balls(totals, "balls_faced", "batsman")
    faced = F.col("season_balls")
    # Who never faced a ball is on no list of excluded strikers.
    kept = counted.where((faced == 0) | (faced > max_excluded_balls))
    return _in_a_stage(kept)


def excluded_batsmen(
    deliveries: DataFrame, matches: DataFrame, max_balls: int = MAX_EXCLUDED_BALLS_FACED
) -> DataFrame:
    """Batsman-seasons of at most ``max_balls`` balls faced, from balls added up per match first."""
    return excluded_of(match_volume(deliveries, "batsman"), matches, max_balls)


def excluded_of(volume: DataFrame, matches: DataFrame, max_balls: int) -> DataFrame:
    """The same from the ``balls`` that a batsman faced, in rows of one match each."""
    return (
        attach_season(volume.select("match_id", "batsman", "balls"), matches)
        .groupBy("batsman", "season")
        .agg(F.sum("balls").alias("faced"))
        .where(F.col("faced") <= max_balls)
        .select("batsman", "season")
    )


def _with_season_balls(totals: DataFrame, measure: str, player: str) -> DataFrame:
    """Adds the balls of the player-season, those outside every stage included."""
    season = Window.partitionBy(player, "season")
    return totals.withColumn("season_balls", F.sum(measure).over(season))


def _in_a_stage(totals: DataFrame) -> DataFrame:
    return totals.where(F.col("stage").isNotNull()).drop("season_balls")
