"""Batting measures.

Only the striker decides whether a ball counts: balls of an excluded striker are gone for the
non-striker and for the dismissed player as well.

``batting_summary`` computes all measures in one pass: balls are added up per partnership, each
partnership is turned into one row per player and role, and those are added up per match and then
per player.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketworks.functions import (
    clear_infinite,
    clear_nan,
    fill_missing,
    ieee_ratio,
    null_safe_join,
    round_numeric,
    rows,
    strict_sum,
)
from wicketworks.operators.qualify import qualified_batting
from wicketworks.schema import BATTING

KEYS = ("batsman", "inning", "season")


def striker_appearances(facts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Matches in which a player faced a ball."""
    return facts.groupBy(*_with(keys, "match_id")).agg(rows().alias("innings"))


def non_striker_appearances(facts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Matches in which a player stood at the other end."""
    return striker_appearances(_as_batsman(facts, "non_striker"), keys)


def innings_played(facts: DataFrame, exclusions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Matches in which a player was at either end."""
    both = striker_appearances(facts, keys).unionByName(
        non_striker_appearances(facts, keys), allowMissingColumns=True
    )
    matches = both.select(*_with(keys, "match_id")).distinct()
    played = matches.groupBy(*keys).agg(rows().alias("innings_played"))
    return qualified_batting(played, exclusions)


def dismissals(facts: DataFrame, exclusions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Times out, whatever the kind, per dismissed player."""
    out = _as_batsman(facts.where(F.col("player_dismissed") != ""), "player_dismissed")
    return qualified_batting(out.groupBy(*keys).agg(rows().alias("dismissed")), exclusions)


def not_outs(dismissed: DataFrame, played: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Innings played less dismissals, for every player with an innings; null if never out."""
    joined = null_safe_join(dismissed, played, keys, "right")
    return joined.select(
        *keys,
        "dismissed",
        "innings_played",
        (F.col("innings_played") - F.col("dismissed")).alias("not_out"),
    )


def runs_made(facts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs off the bat; null if one ball of the group has none recorded."""
    return facts.groupBy(*keys).agg(strict_sum("batsman_runs").alias("runs_made"))


def balls_faced(facts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Balls faced; every delivery counts."""
    return facts.groupBy(*keys).agg(rows().alias("balls_faced"))


def shots(facts: DataFrame, runs: int, name: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Balls hit for exactly ``runs``."""
    return facts.where(F.col("batsman_runs") == runs).groupBy(*keys).agg(rows().alias(name))


def match_scores(facts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs per match."""
    return facts.groupBy(*_with(keys, "match_id")).agg(strict_sum("batsman_runs").alias("score"))


def highest_score(facts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Best match score; null if the score of one match is not known."""
    scores = match_scores(facts, keys)
    return scores.groupBy(*keys).agg(
        F.when(F.count("score") == rows(), F.max("score")).alias("maximum_score")
    )


def milestones(facts: DataFrame, reached: Column, name: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Matches whose ``score`` meets the condition."""
    return match_scores(facts, keys).where(reached).groupBy(*keys).agg(rows().alias(name))


def is_century() -> Column:
    return F.col("score") > 99


def is_half_century() -> Column:
    return F.col("score").between(50, 99)


def batting_measures(facts: DataFrame, exclusions: DataFrame, keys: Sequence[str] = KEYS) -> list[DataFrame]:
    """The eight measure tables one by one, to be merged on their keys."""
    return [
        not_outs(dismissals(facts, exclusions, keys), innings_played(facts, exclusions, keys), keys),
        runs_made(facts, keys),
        balls_faced(facts, keys),
        highest_score(facts, keys),
        milestones(facts, is_century(), "centuries", keys),
        milestones(facts, is_half_century(), "half_centuries", keys),
        shots(facts, 4, "boundries", keys),
        shots(facts, 6, "sixes", keys),
    ]


# One pass -------------------------------------------------------------------


def partnership_totals(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per match, striker, non-striker and dismissed player. ``keys`` name the rest."""
    return facts.groupBy(*_with(keys, "match_id", "batsman", "non_striker", "player_dismissed")).agg(
        rows().alias("balls"),
        F.coalesce(F.sum("batsman_runs"), F.lit(0)).alias("runs"),
        F.count_if(F.col("batsman_runs").isNull()).alias("unknown"),
        F.count_if(F.col("batsman_runs") == 4).alias("fours"),
        F.count_if(F.col("batsman_runs") == 6).alias("sixes"),
    )


def player_roles(partnerships: DataFrame, keys: Sequence[str], striker_counts: Column) -> DataFrame:
    """Each partnership as a row for the striker, one for the non-striker, one for who got out.

    ``striker_counts`` says whether the striker is qualified. If not, only the striker's own row
    is kept.
    """
    zero = F.lit(0).cast("long")

    def role(player: str, batted: bool, at_crease: bool, out: bool) -> Column:
        def measure(name: str) -> Column:
            return (F.col(name) if batted else zero).alias(name)

        return F.struct(
            F.col(player).alias("player"),
            measure("balls"),
            measure("runs"),
            measure("unknown"),
            measure("fours"),
            measure("sixes"),
            F.lit(int(at_crease)).cast("long").alias("at_crease"),
            (F.col("balls") if out else zero).alias("dismissed"),
        )

    striker = role("batsman", batted=True, at_crease=True, out=False)
    non_striker = role("non_striker", batted=False, at_crease=True, out=False)
    dismissed = role("player_dismissed", batted=False, at_crease=False, out=True)
    roles = (
        F.when(~striker_counts, F.array(striker))
        .when(F.col("player_dismissed") != "", F.array(striker, non_striker, dismissed))
        .otherwise(F.array(striker, non_striker))
    )
    others = [k for k in keys if k != "batsman"]
    return partnerships.select(*others, "match_id", F.inline(roles)).withColumnRenamed("player", "batsman")


def player_match_totals(roles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and match."""
    sums = ("balls", "runs", "unknown", "fours", "sixes", "dismissed")
    return roles.groupBy(*_with(keys, "match_id")).agg(
        *(F.sum(c).alias(c) for c in sums), F.max("at_crease").alias("at_crease")
    )


def player_totals(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key."""
    known = F.col("unknown") == 0
    scored = matches.withColumn("score", F.when(known & (F.col("balls") > 0), F.col("runs")))
    all_known = F.sum("unknown") == 0
    return scored.groupBy(*keys).agg(
        F.sum("dismissed").alias("dismissed"),
        F.sum("at_crease").alias("innings_played"),
        F.when(all_known, F.sum("runs")).alias("runs_made"),
        F.sum("balls").alias("balls_faced"),
        F.when(all_known, F.max("score")).alias("maximum_score"),
        F.count_if(is_century()).alias("centuries"),
        F.count_if(is_half_century()).alias("half_centuries"),
        F.sum("fours").alias("boundries"),
        F.sum("sixes").alias("sixes"),
    )


def with_not_outs(totals: DataFrame) -> DataFrame:
    """Not-outs for the players with an innings, the others dropped; null if never out."""
    times_out = F.nullif(F.col("dismissed"), F.lit(0))
    return totals.where(F.col("innings_played") > 0).withColumn(
        "not_out", F.col("innings_played") - times_out
    )


def as_merged(totals: DataFrame) -> DataFrame:
    """Totals of qualified players as the eight measure tables merged on their keys would show them.

    A measure that a key has no row for is missing there, not 0: the striker's for who never faced a ball, and counts of
    some of the rows for who has none.
    """
    faced = {c: F.when(F.col("balls_faced") > 0, F.col(c)) for c in ("runs_made", "balls_faced")}
    counted = ("dismissed", "centuries", "half_centuries", "boundries", "sixes")
    return with_not_outs(totals).withColumns({**faced, **{c: F.nullif(F.col(c), F.lit(0)) for c in counted}})


def finish_batting(measures: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Ratios over the measures, with missing and infinite values as 0 and one decimal."""
    rated = fill_missing(measures).withColumns(
        {r.name: ieee_ratio(F.col(r.top), F.col(r.bottom)) * r.times for r in BATTING.ratios}
    )
    cleared = round_numeric(clear_nan(clear_infinite(rated)))
    return cleared.select(*keys, *BATTING.measures, *(r.name for r in BATTING.ratios))


def batting_summary(facts: DataFrame, exclusions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All batting measures of a table of qualified facts per key."""
    partnerships = partnership_totals(facts, keys)
    roles = player_roles(partnerships, keys, F.lit(True))
    totals = player_totals(player_match_totals(roles, keys), keys)
    return finish_batting(with_not_outs(qualified_batting(totals, exclusions)), keys)


def _as_batsman(facts: DataFrame, role: str) -> DataFrame:
    return facts.drop("batsman").withColumnRenamed(role, "batsman")


def _with(keys: Sequence[str], *more: str) -> list[str]:
    return list(dict.fromkeys([*keys, *more]))
