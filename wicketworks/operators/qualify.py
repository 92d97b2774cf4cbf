"""Players with too few balls in a season, and the facts without them.

Who qualifies is decided per player and season, but no ball is moved by player for it. Balls are added up per match
and player, the players who fall short are listed per match, and the balls meet that list where they meet their match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicketworks.functions import is_small, null_safe_join, paste_key, rows, strict_sum
from wicketworks.operators.combine import attach_season
from wicketworks.schema import BALLS_PER_OVER, MAX_EXCLUDED_BALLS_FACED, MAX_EXCLUDED_OVERS


def bowler_volume(facts: DataFrame) -> DataFrame:
    """Balls and overs bowled per bowler and season."""
    return (
        facts.groupBy("bowler", "season")
        .agg(rows().alias("balls"))
        .select(
            "bowler",
            "season",
            "balls",
            paste_key("bowler", "season").alias("combine"),
            (F.col("balls") / F.lit(float(BALLS_PER_OVER))).alias("overs"),
        )
    )


def bowler_exclusions(facts: DataFrame, max_overs: float = MAX_EXCLUDED_OVERS) -> DataFrame:
    """Bowler-seasons of at most ``max_overs`` overs."""
    return bowler_volume(facts).where(F.col("overs") <= max_overs)


def qualified_bowling(facts: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Balls bowled by bowlers that are not excluded in that season."""
    return _without(facts, exclusions, "bowler")


def batsman_volume(facts: DataFrame) -> DataFrame:
    """Balls faced and runs made per striker and season; runs are missing if those of a ball are."""
    return facts.groupBy("batsman", "season").agg(
        rows().alias("ballsfaced"), strict_sum("batsman_runs").alias("runs")
    )


def batsman_exclusions(facts: DataFrame, max_balls: int = MAX_EXCLUDED_BALLS_FACED) -> DataFrame:
    """Striker-seasons of at most ``max_balls`` balls."""
    return (
        batsman_volume(facts)
        .where(F.col("ballsfaced") <= max_balls)
        .withColumn("combine_batsman", paste_key("batsman", "season"))
    )


def qualified_batting(facts: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Rows of players that are not excluded in that season.

    For facts this looks at the striker only. Summary tables with a ``batsman`` column qualify
    the same way.
    """
    return _without(facts, exclusions, "batsman")


def _without(facts: DataFrame, exclusions: DataFrame, player: str) -> DataFrame:
    """Facts without the listed player-seasons.

    A list that is stored, or known to be small, is joined as it is, and Spark broadcasts it. Any other
    would make Spark move the facts by player, where one player may have a third of them. So it is spread
    over the matches first: (match, player, season), added up in the map tasks, meet the list, and the facts meet the
    players listed for their match. Tables without a match are small, and always joined as they are.
    """
    listed = exclusions.select(player, "season")
    if "match_id" not in facts.columns or is_small(listed):
        return null_safe_join(facts, listed, [player, "season"], "left_anti")
    known = facts.where(F.col("match_id").isNotNull())
    played = known.select("match_id", player, "season").distinct()
    short = null_safe_join(played, listed, [player, "season"], "left_semi")
    kept = drop_listed(known.join(listed_per_match(short, player), "match_id", "left"), player)
    # Facts that were joined with their match have one; Spark sees that this part is empty and leaves it out.
    return kept.unionByName(null_safe_join(facts.where(F.col("match_id").isNull()), listed, [player, "season"], "left_anti"))


def match_volume(deliveries: DataFrame, player: str) -> DataFrame:
    """Balls per match and player. The map tasks add up most of them."""
    return deliveries.groupBy("match_id", player).agg(rows().alias("balls"))


def short_in_season(volume: DataFrame, matches: DataFrame, player: str, falls_short: Column) -> DataFrame:
    """The rows of ``match_volume`` whose player falls short in the season; ``falls_short`` looks at ``season_balls``."""
    season = Window.partitionBy(player, "season")
    counted = attach_season(volume, matches).withColumn("season_balls", F.sum("balls").over(season))
    return counted.where(falls_short)


def listed_per_match(short: DataFrame, player: str) -> DataFrame:
    """(match_id, listed): the player-seasons of each match that fall short; as many as play in a match at most."""
    return short.groupBy("match_id").agg(F.collect_set(F.struct(player, "season")).alias("listed"))


def drop_listed(facts: DataFrame, player: str) -> DataFrame:
    """Facts whose player is not among the ``listed`` of their match; a missing player is listed as such."""
    is_listed = F.array_contains("listed", F.struct(player, "season"))
    return facts.where(F.col("listed").isNull() | ~is_listed).drop("listed")
