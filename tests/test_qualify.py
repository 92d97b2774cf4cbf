import pytest

from balls import ball, deliveries, dicts, matches, one
from wicketworks.operators.combine import combine
from wicketworks.operators.qualify import (
    batsman_exclusions,
    bowler_exclusions,
    bowler_volume,
    qualified_batting,
    qualified_bowling,
)
from wicketworks.plans import batting_mart, bowling_mart

pytestmark = pytest.mark.usefixtures("tiny_plans")


def facts_of(spark, *groups, seasons=None):
    return combine(deliveries(spark, *groups), matches(spark, seasons))


def test_combine_is_an_inner_join_that_keeps_extra_columns(spark):
    games = spark.createDataFrame([(1, 2008, "Eden"), (9, 2009, "Oval")], "id bigint, season int, venue string")
    rows = dicts(combine(deliveries(spark, ball(2), ball(match_id=5)), games))
    assert len(rows) == 2 and {(r["match_id"], r["season"], r["venue"]) for r in rows} == {(1, 2008, "Eden")}


def test_bowlers_need_more_than_25_overs_in_the_season(spark):
    balls = [
        ball(150, bowler="Low"),
        ball(151, bowler="High"),
        ball(149, bowler="Split"),
        ball(2, bowler="Split", match_id=2),
    ]
    facts = facts_of(spark, *balls, seasons={1: 2008, 2: 2009})
    excluded = {(r["bowler"], r["season"]) for r in dicts(bowler_exclusions(facts))}
    assert excluded == {("Low", 2008), ("Split", 2008), ("Split", 2009)}
    volume = one(bowler_volume(facts).where("bowler = 'Low'"))
    assert (volume["balls"], volume["overs"], volume["combine"]) == (150, 25.0, "Low2008")
    kept = dicts(qualified_bowling(facts, bowler_exclusions(facts)))
    assert len(kept) == 151 and {r["bowler"] for r in kept} == {"High"}
    mart = bowling_mart(deliveries(spark, *balls), matches(spark, {1: 2008, 2: 2009}))
    assert {r["bowler"] for r in dicts(mart)} == {"High"}


def test_batsmen_need_more_than_90_balls_in_the_season(spark):
    balls = [ball(90, batsman="Low", non_striker="High"), ball(91, batsman="High", non_striker="Low")]
    facts = facts_of(spark, *balls)
    excluded = batsman_exclusions(facts)
    assert {r["batsman"] for r in dicts(excluded)} == {"Low"}
    assert len(dicts(qualified_batting(facts, excluded))) == 91
    row = one(batting_mart(deliveries(spark, *balls), matches(spark)))
    assert (row["batsman"], row["balls_faced"]) == ("High", 91)


def test_balls_without_an_over_count_for_the_volume_only(spark):
    balls = [ball(100), ball(60, over=None)]
    row = one(bowling_mart(deliveries(spark, *balls), matches(spark)))
    assert (row["balls"], row["stage"]) == (100, "Powerplay")
    faced = [ball(80), ball(11, over=None)]
    rows = dicts(batting_mart(deliveries(spark, *faced), matches(spark)))
    assert {(r["batsman"], r["balls_faced"]) for r in rows} == {("Striker", 80), ("Partner", 0)}


def test_missing_players_are_excluded_like_any_other(spark):
    balls = [ball(100, bowler=None, batsman="Good"), ball(151, batsman="Good"), ball(50, batsman=None)]
    facts = facts_of(spark, *balls)
    assert {r["bowler"] for r in dicts(qualified_bowling(facts, bowler_exclusions(facts)))} == {"Bowler"}
    assert {r["batsman"] for r in dicts(qualified_batting(facts, batsman_exclusions(facts)))} == {"Good"}
    assert {r["bowler"] for r in dicts(bowling_mart(deliveries(spark, *balls), matches(spark)))} == {"Bowler"}
    names = {r["batsman"] for r in dicts(batting_mart(deliveries(spark, *balls), matches(spark)))}
    assert names == {"Good", "Partner"}


def test_thresholds_are_parameters(spark):
    balls = deliveries(spark, ball(12))
    assert one(bowling_mart(balls, matches(spark), max_excluded_overs=1))["balls"] == 12
    assert len(dicts(batting_mart(balls, matches(spark), max_excluded_balls=11))) == 2
