"""Every registered query: name -> function of the session and the folder of the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicketworks.checks import views
from wicketworks.functions import (
    natural_full_join,
    paste_key,
    with_stage,
)
from wicketworks.operators import batting, bowling
from wicketworks.operators.combine import combine
from wicketworks.operators.distinct import first_seen, pick_positions, player_choices, seasons
from wicketworks.operators.lattice import lattice
from wicketworks.operators.qualify import (
    batsman_exclusions,
    batsman_volume,
    bowler_exclusions,
    bowler_volume,
)
from wicketworks.operators.ranking import page
from wicketworks.operators.rollup import select_inning
from wicketworks.plans import (
    batting_mart,
    bowling_mart,
    compare_players,
    compare_seasons,
    leaderboard,
    selection,
    top_players,
)
from wicketworks.plans.facts import batting_facts, bowling_facts
from wicketworks.plans.marts import BATTING_KEYS, BOWLING_KEYS, batting_totals, bowling_totals, excluded_batsmen
from wicketworks.schema import BATTING, BOWLING, DEFAULT_SEASON, Discipline

Query = Callable[[SparkSession, str], DataFrame]

BOWLER_1, BOWLER_2 = "Bowler 5", "Bowler 21"


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine(views.deliveries(spark, sf_dir), views.matches(spark, sf_dir))


def _bowling_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bowling_facts(views.deliveries(spark, sf_dir), views.matches(spark, sf_dir))


def _batting_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    balls, games = views.deliveries(spark, sf_dir), views.matches(spark, sf_dir)
    return batting_facts(balls, games), excluded_batsmen(balls, games)


def _bowling_mart(spark: SparkSession, sf_dir: str, season: int | None = None) -> DataFrame:
    return bowling_mart(views.deliveries(spark, sf_dir), views.matches(spark, sf_dir), season=season)


def _batting_mart(spark: SparkSession, sf_dir: str, season: int | None = None) -> DataFrame:
    return batting_mart(views.deliveries(spark, sf_dir), views.matches(spark, sf_dir), season=season)


def _on_facts(function: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: function(_combined(spark, sf_dir))


def _on_bowling(function: Callable[..., DataFrame], *args) -> Query:
    """A bowling measure per stage, of the qualified facts."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(with_stage(_bowling_facts(spark, sf_dir)), *args, keys=BOWLING_KEYS)

    return query


def _on_batting(function: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """A batting measure per stage, of the qualified facts."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts, exclusions = _batting_facts(spark, sf_dir)
        return function(with_stage(facts), exclusions)

    return query


def _bowling_stage_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of the stages one below the other: grouped once, with the stage as a key."""
    return bowling.bowling_summary(with_stage(_bowling_facts(spark, sf_dir)), BOWLING_KEYS)


def _batting_stage_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = batting_totals(views.deliveries(spark, sf_dir), views.matches(spark, sf_dir))
    return batting.finish_batting(batting.with_not_outs(totals), BATTING_KEYS)


def _bowling_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bowling.as_merged(bowling_totals(views.deliveries(spark, sf_dir), views.matches(spark, sf_dir)))


def _batting_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batting.as_merged(batting_totals(views.deliveries(spark, sf_dir), views.matches(spark, sf_dir)))


def _batting_not_outs(facts: DataFrame, exclusions: DataFrame) -> DataFrame:
    return batting.not_outs(
        batting.dismissals(facts, exclusions, BATTING_KEYS),
        batting.innings_played(facts, exclusions, BATTING_KEYS),
        BATTING_KEYS,
    )


def _first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    balls = views.numbered_deliveries(spark, sf_dir)
    seen = first_seen(balls, "dismissal_kind", F.col("rowno"))
    return seen.select("dismissal_kind", F.col("first_seen.o0").alias("first_row"))


def _credited_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    balls = views.numbered_deliveries(spark, sf_dir)
    return pick_positions(first_seen(balls, "dismissal_kind", F.col("rowno"))).select(
        "dismissal_kind", "position"
    )


def _on_mart(mart: Query, function: Callable[..., DataFrame], *args, **options) -> Query:
    return lambda spark, sf_dir: function(mart(spark, sf_dir), *args, **options)


def _of_season(mart: Callable[..., DataFrame], function: Callable[..., DataFrame], discipline: Discipline, season: int = DEFAULT_SEASON, *args, **options) -> Query:
    """A request for one season, from the balls of that season."""
    return lambda spark, sf_dir: function(mart(spark, sf_dir, season), discipline, season, *args, **options)


def _year_inning(mart: DataFrame, discipline: Discipline, season: int, inning: str) -> DataFrame:
    return select_inning(mart.where(F.col("season") == season), discipline, inning)


def _second_page(mart: DataFrame, discipline: Discipline, season: int) -> DataFrame:
    return page(leaderboard(mart, discipline, season), 2)


def _rollups() -> dict[str, Query]:
    """Each request of the two tables before its columns are chosen."""
    named: dict[str, Query] = {}
    for name, mart, discipline in (
        ("bowling", _bowling_mart, BOWLING),
        ("batting", _batting_mart, BATTING),
    ):
        for inning, label in (("1", "1"), ("2", "2"), ("1 & 2", "all")):
            named[f"{name}_inning_{label}"] = _of_season(mart, _year_inning, discipline, 2008, inning)
        for stage, label in (
            ("Powerplay (1-6)", "powerplay"),
            ("Middle (7-15)", "middle"),
            ("Death (16-20)", "death"),
        ):
            named[f"{name}_stage_{label}"] = _of_season(mart, selection, discipline, 2009, "1 & 2", stage)
        named[f"{name}_complete"] = _of_season(mart, selection, discipline, 2008)
        named[f"{name}_complete_inning_1"] = _of_season(mart, selection, discipline, 2009, "1")
        named[f"{name}_inning_2_death"] = _of_season(
            mart, selection, discipline, 2009, "2", "Death (16-20)"
        )
    return named


def _rankings() -> dict[str, Query]:
    named: dict[str, Query] = {}
    for name, mart, discipline in (
        ("bowling", _bowling_mart, BOWLING),
        ("batting", _batting_mart, BATTING),
    ):
        for metric in discipline.metrics:
            named[f"leaderboard_{name}_{metric}"] = _of_season(mart, leaderboard, discipline, metric=metric)
            named[f"top6_{name}_{metric}"] = _of_season(mart, top_players, discipline, metric=metric)
        named[f"top6_{name}_unknown_metric"] = _of_season(
            mart, top_players, discipline, metric="Wickets taken"
        )
    return named


def registered() -> dict[str, Query]:
    keys = BATTING_KEYS
    return {
        # Facts and who qualifies.
        "combined_facts": _combined,
        "bowler_volume": _on_facts(bowler_volume),
        "bowler_exclusions": _on_facts(bowler_exclusions),
        "bowler_qualified": _bowling_facts,
        "batsman_volume": _on_facts(batsman_volume),
        "batsman_exclusions": _on_facts(batsman_exclusions),
        "batsman_qualified": lambda spark, sf_dir: _batting_facts(spark, sf_dir)[0].withColumn(
            "combine_batsman", paste_key("batsman", "season")
        ),
        "dismissal_first_seen": _first_seen,
        "dismissal_credited_by_position": _credited_by_position,
        # Bowling measures.
        "bowling_balls": _on_bowling(bowling.balls_and_overs),
        "bowling_dots": _on_bowling(bowling.dot_balls),
        "bowling_maidens": _on_bowling(bowling.maidens),
        "bowling_runs": _on_bowling(bowling.runs_conceded),
        "bowling_wickets": _on_bowling(bowling.wickets),
        "bowling_matches": _on_bowling(bowling.matches_bowled),
        "bowling_five": _on_bowling(bowling.hauls, 4, "fivewicket"),
        "bowling_four": _on_bowling(bowling.hauls, 3, "fourwicket"),
        "bowling_merge_all": _bowling_merged,
        "bowling_summary": lambda spark, sf_dir: bowling.bowling_summary(_bowling_facts(spark, sf_dir)),
        "bowling_stage_union": _bowling_stage_union,
        "bowling_mart": _bowling_mart,
        # Batting measures.
        "batting_striker_appearances": _on_batting(lambda f, x: batting.striker_appearances(f, keys)),
        "batting_non_striker_appearances": _on_batting(
            lambda f, x: batting.non_striker_appearances(f, keys)
        ),
        "batting_appearances": _on_batting(lambda f, x: batting.innings_played(f, x, keys)),
        "batting_dismissals": _on_batting(lambda f, x: batting.dismissals(f, x, keys)),
        "batting_not_outs": _on_batting(_batting_not_outs),
        "batting_runs_balls": _on_batting(
            lambda f, x: natural_full_join(batting.runs_made(f, keys), batting.balls_faced(f, keys))
        ),
        "batting_boundaries": _on_batting(
            lambda f, x: natural_full_join(
                batting.shots(f, 4, "boundries", keys), batting.shots(f, 6, "sixes", keys)
            )
        ),
        "batting_highest": _on_batting(lambda f, x: batting.highest_score(f, keys)),
        "batting_milestones": _on_batting(
            lambda f, x: natural_full_join(
                batting.milestones(f, batting.is_century(), "centuries", keys),
                batting.milestones(f, batting.is_half_century(), "half_centuries", keys),
            )
        ),
        "batting_merge_all": _batting_merged,
        "batting_summary": lambda spark, sf_dir: batting.batting_summary(*_batting_facts(spark, sf_dir)),
        "batting_stage_union": _batting_stage_union,
        "batting_mart": _batting_mart,
        "bowling_lattice": _on_mart(_bowling_mart, lattice, BOWLING),
        "batting_lattice": _on_mart(_batting_mart, lattice, BATTING),
        # The same with values missing in every column but the match.
        "batsman_volume_missing": lambda spark, sf_dir: batsman_volume(
            combine(views.missing_deliveries(spark, sf_dir), views.missing_matches(spark, sf_dir))
        ),
        "bowling_mart_missing": lambda spark, sf_dir: bowling_mart(
            views.missing_deliveries(spark, sf_dir), views.missing_matches(spark, sf_dir)
        ),
        "batting_mart_missing": lambda spark, sf_dir: batting_mart(
            views.missing_deliveries(spark, sf_dir), views.missing_matches(spark, sf_dir)
        ),
        # Requests.
        **_rollups(),
        **_rankings(),
        "leaderboard_bowling_inning_1_powerplay": _of_season(
            _bowling_mart, leaderboard, BOWLING, 2009, "1", "Powerplay (1-6)", "economy"
        ),
        "leaderboard_batting_inning_2_middle": _of_season(
            _batting_mart, leaderboard, BATTING, 2009, "2", "Middle (7-15)", "strike_rate"
        ),
        "page_2_bowling": _of_season(_bowling_mart, _second_page, BOWLING),
        "page_2_batting": _of_season(_batting_mart, _second_page, BATTING),
        "bowler_compare_p1": _on_mart(
            _bowling_mart, compare_players, BOWLER_1, BOWLER_2, "overs", "wickets"
        ),
        "bowler_compare_same_parameter": _on_mart(
            _bowling_mart, compare_players, BOWLER_1, BOWLER_2, "economy", "economy"
        ),
        "bowler_compare_p2": _on_mart(_bowling_mart, compare_seasons, BOWLER_1, BOWLER_2),
        # Choice lists.
        "seasons": lambda spark, sf_dir: seasons(
            views.deliveries(spark, sf_dir), views.matches(spark, sf_dir)
        ),
        "bowler_choices": _on_mart(_bowling_mart, player_choices),
        "bowler_choices_distinct": _on_mart(_bowling_mart, player_choices, repeats=False),
    }
