"""Bowling measures.

The single-measure functions read facts with a season and can be used on their own.
``bowling_summary`` computes all of them in one pass: balls are added up per over, overs per match,
matches per player, so each exchange moves rows that were already combined in the map tasks. Match
and over are part of the first keys, which spreads a bowler with very many balls over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketworks.functions import fill_missing, guarded_ratio, round_numeric, rows, strict_sum
from wicketworks.schema import BALLS_PER_OVER, BOWLING, CREDITED_DISMISSALS

KEYS = ("bowler", "inning", "season")


def is_credited(kinds: Sequence[str] = CREDITED_DISMISSALS) -> Column:
    """Dismissals that count for the bowler."""
    return F.col("dismissal_kind").isin(*kinds)


def balls_and_overs(facts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Balls bowled, and the same in overs. Every delivery counts, extras too."""
    return facts.groupBy(*keys).agg(rows().alias("balls")).withColumn("overs", _overs())


def dot_balls(facts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Balls without a run."""
    return facts.where(F.col("total_runs") == 0).groupBy(*keys).agg(rows().alias("dotballs"))


def maidens(facts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Overs of at least six balls without a run."""
    overs = facts.groupBy(*_with(keys, "match_id", "over")).agg(
        strict_sum("total_runs").alias("runsgiven"), rows().alias("balls")
    )
    return (
        overs.where((F.col("runsgiven") == 0) & (F.col("balls") >= BALLS_PER_OVER))
        .groupBy(*keys)
        .agg(rows().alias("maiden"))
    )


def runs_conceded(facts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs off the bat and extras; null if one ball of the group has none recorded."""
    return facts.groupBy(*keys).agg(
        strict_sum("batsman_runs").alias("bat_runs"), strict_sum("extra_runs").alias("extra_runs")
    )


def wickets(
    facts: DataFrame, keys: Sequence[str] = KEYS, kinds: Sequence[str] = CREDITED_DISMISSALS
) -> DataFrame:
    """Dismissals credited to the bowler."""
    return facts.where(is_credited(kinds)).groupBy(*keys).agg(rows().alias("wickets"))


def matches_bowled(facts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Matches with at least one ball. A missing match id counts as a match."""
    return facts.select(*_with(keys, "match_id")).distinct().groupBy(*keys).agg(rows().alias("matches"))


def hauls(
    facts: DataFrame,
    more_than: int,
    name: str,
    keys: Sequence[str] = KEYS,
    kinds: Sequence[str] = CREDITED_DISMISSALS,
) -> DataFrame:
    """Matches with more than ``more_than`` credited wickets."""
    return (
        wickets(facts, _with(keys, "match_id"), kinds)
        .where(F.col("wickets") > more_than)
        .groupBy(*keys)
        .agg(rows().alias(name))
    )


def bowling_measures(
    facts: DataFrame, keys: Sequence[str] = KEYS, kinds: Sequence[str] = CREDITED_DISMISSALS
) -> list[DataFrame]:
    """The eight measure tables one by one, to be merged on their keys."""
    return [
        balls_and_overs(facts, keys),
        dot_balls(facts, keys),
        maidens(facts, keys),
        runs_conceded(facts, keys),
        wickets(facts, keys, kinds),
        matches_bowled(facts, keys),
        hauls(facts, 4, "fivewicket", keys, kinds),
        hauls(facts, 3, "fourwicket", keys, kinds),
    ]


# One pass -------------------------------------------------------------------


def over_totals(
    facts: DataFrame, keys: Sequence[str], kinds: Sequence[str] = CREDITED_DISMISSALS
) -> DataFrame:
    """One row per bowler, match and over. ``keys`` need not hold the season."""
    return facts.groupBy(*_with(keys, "match_id", "over")).agg(
        rows().alias("balls"),
        F.count_if(F.col("total_runs") == 0).alias("dotballs"),
        strict_sum("total_runs").alias("runsgiven"),
        strict_sum("batsman_runs").alias("bat_runs"),
        strict_sum("extra_runs").alias("extra_runs"),
        F.count_if(is_credited(kinds)).alias("wickets"),
    )


def match_totals(overs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and match."""
    is_maiden = (F.col("runsgiven") == 0) & (F.col("balls") >= BALLS_PER_OVER)
    return overs.groupBy(*_with(keys, "match_id")).agg(
        F.sum("balls").alias("balls"),
        F.sum("dotballs").alias("dotballs"),
        F.count_if(is_maiden).alias("maiden"),
        strict_sum("bat_runs").alias("bat_runs"),
        strict_sum("extra_runs").alias("extra_runs"),
        F.sum("wickets").alias("wickets"),
    )


def player_totals(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key."""
    return matches.groupBy(*keys).agg(
        F.sum("balls").alias("balls"),
        F.sum("dotballs").alias("dotballs"),
        F.sum("maiden").alias("maiden"),
        strict_sum("bat_runs").alias("bat_runs"),
        strict_sum("extra_runs").alias("extra_runs"),
        F.sum("wickets").alias("wickets"),
        rows().alias("matches"),
        F.count_if(F.col("wickets") > 4).alias("fivewicket"),
        F.count_if(F.col("wickets") > 3).alias("fourwicket"),
    )


def as_merged(totals: DataFrame) -> DataFrame:
    """Totals as the eight measure tables merged on their keys would show them.

    A measure that counts some of the rows only has no row for a key without any, so it is missing there, not 0.
    """
    counted = ("dotballs", "maiden", "wickets", "fivewicket", "fourwicket")
    return totals.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in counted}).withColumn("overs", _overs())


def finish_bowling(totals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Overs and ratios, missing values as 0, one decimal."""
    filled = fill_missing(totals).withColumn("overs", _overs())
    rated = filled.withColumns(
        {r.name: guarded_ratio(F.col(r.top), F.col(r.bottom)) * r.times for r in BOWLING.ratios}
    )
    return round_numeric(rated).select(*keys, *BOWLING.measures, *(r.name for r in BOWLING.ratios))


def bowling_summary(
    facts: DataFrame, keys: Sequence[str] = KEYS, kinds: Sequence[str] = CREDITED_DISMISSALS
) -> DataFrame:
    """All bowling measures of a fact table per key."""
    overs = over_totals(facts, keys, kinds)
    return finish_bowling(player_totals(match_totals(overs, keys), keys), keys)


def _overs() -> Column:
    return F.col("balls") / F.lit(float(BALLS_PER_OVER))


def _with(keys: Sequence[str], *more: str) -> list[str]:
    return list(dict.fromkeys([*keys, *more]))
