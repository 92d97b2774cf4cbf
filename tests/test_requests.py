"""Roll-ups, rankings, pages and comparisons on hand-written marts."""

import math

import pytest

from balls import dicts, one
from wicketworks.operators.distinct import player_choices
from wicketworks.operators.ranking import metric_table, page, top
from wicketworks.plans import compare_players, compare_seasons, leaderboard, selection, top_players
from wicketworks.schema import (
    BATTING,
    BATTING_COLUMNS,
    BATTING_MART,
    BOWLING,
    BOWLING_MART,
    BOWLING_PRESETS,
    INNING_CHOICES,
    STAGE_CHOICES,
)

pytestmark = pytest.mark.usefixtures("tiny_plans")


def mart(spark, schema, *rows):
    """Rows with 0 wherever nothing is given."""
    base = {f.name: 0 if f.dataType.typeName() != "double" else 0.0 for f in schema}
    base |= {"stage": "Powerplay", "season": 2008, "inning": 1}
    return spark.createDataFrame([tuple((base | row)[n] for n in schema.names) for row in rows], schema)


def bowling(spark, *rows):
    return mart(spark, BOWLING_MART, *({"bowler": "A"} | r for r in rows))


def batting(spark, *rows):
    return mart(spark, BATTING_MART, *({"batsman": "A"} | r for r in rows))


def test_rounded_overs_are_summed_and_rounded_again(spark):
    seven = {"balls": 7, "overs": 1.2, "bat_runs": 5}
    row = one(selection(bowling(spark, seven, seven | {"stage": "Death"}), BOWLING))
    assert (row["balls"], row["overs"], row["economy"]) == (14, 2.4, 4.2)


def test_wicketless_is_infinite_or_nan_once_rolled_up(spark):
    table = bowling(spark, {"bat_runs": 10, "balls": 6, "overs": 1.0}, {"bowler": "B", "balls": 6, "overs": 1.0})
    passed = {r["bowler"]: r["bow_avg"] for r in dicts(selection(table, BOWLING, inning=1, stage="Powerplay (1-6)"))}
    assert passed == {"A": 0.0, "B": 0.0}
    rolled = {r["bowler"]: r["bow_avg"] for r in dicts(selection(table, BOWLING))}
    assert rolled["A"] == math.inf and math.isnan(rolled["B"])
    ranked = dicts(leaderboard(table, BOWLING, metric="bow_avg"))
    assert [r["bowler"] for r in ranked] == ["A", "B"]


def test_both_innings_include_super_overs(spark):
    table = bowling(spark, *({"inning": i, "balls": i} for i in (1, 2, 3)))
    assert one(selection(table, BOWLING))["balls"] == 6
    assert one(selection(table, BOWLING, inning="1"))["balls"] == 1
    assert one(selection(table, BOWLING, inning=2))["balls"] == 2


def test_one_season_and_one_stage(spark):
    table = bowling(
        spark, {"balls": 1}, {"balls": 2, "stage": "Death"}, {"balls": 4, "season": 2009}, {"balls": 8, "inning": 2}
    )
    assert one(selection(table, BOWLING, "2009"))["balls"] == 4
    assert one(selection(table, BOWLING, stage="Death (16-20)"))["balls"] == 2
    assert one(selection(table, BOWLING, stage="Powerplay (1-6)"))["balls"] == 9
    assert one(selection(table, BOWLING, inning=1, stage="Powerplay (1-6)"))["balls"] == 1


def test_batting_takes_the_best_score_and_drops_innings_when_complete(spark):
    table = batting(
        spark,
        {"maximum_score": 40, "runs_made": 40, "innings_played": 1, "balls_faced": 20, "dismissed": 1},
        {"maximum_score": 60, "runs_made": 60, "innings_played": 2, "balls_faced": 30, "inning": 2},
        {"maximum_score": 10, "runs_made": 10, "innings_played": 1, "balls_faced": 25, "stage": "Death"},
    )
    stage = one(selection(table, BATTING, stage="Powerplay (1-6)"))
    assert (stage["maximum_score"], stage["innings_played"], stage["strike_rate"]) == (60, 3, 200.0)
    complete = one(selection(table, BATTING))
    assert "innings_played" not in complete
    assert (complete["maximum_score"], complete["runs_made"], complete["batting_avg"]) == (60, 110, 110.0)


@pytest.mark.parametrize("metric", BOWLING_PRESETS)
def test_bowling_columns_and_order(spark, metric):
    table = bowling(spark, {metric: 1, "bowler": "C"}, {metric: 3, "bowler": "B"}, {metric: 3, "bowler": "A"}) \
        if metric in BOWLING.measures and metric != "overs" else \
        bowling(spark, {metric: 1.0, "bowler": "C"}, {metric: 3.0, "bowler": "B"}, {metric: 3.0, "bowler": "A"})
    ranked = metric_table(table, BOWLING, metric)
    assert ranked.columns == ["bowler", *BOWLING_PRESETS[metric]]
    assert [r["bowler"] for r in dicts(ranked)] == ["A", "B", "C"]


def test_every_batting_metric_shows_the_same_columns(spark):
    table = batting(spark, {"sixes": 1, "batsman": "B"}, {"sixes": 2, "batsman": "A"})
    for metric in BATTING.metrics:
        assert metric_table(table, BATTING, metric).columns == ["batsman", *BATTING_COLUMNS]
    assert [r["batsman"] for r in dicts(metric_table(table, BATTING, "sixes"))] == ["A", "B"]


def test_unknown_metrics(spark):
    assert top(bowling(spark), BOWLING, "Wickets taken").columns == ["bowler", "fivewicket"]
    assert top(batting(spark), BATTING, "nothing").columns == ["batsman", "strike_rate"]
    assert top_players(bowling(spark), BOWLING).columns == ["bowler", "wickets"]
    assert top_players(batting(spark), BATTING).columns == ["batsman", "batting_avg"]


def test_ties_in_the_top_six_are_cut_by_name(spark):
    table = bowling(spark, *({"bowler": b, "wickets": 5} for b in "GFEDCBA"))
    assert [r["bowler"] for r in dicts(top_players(table, BOWLING))] == list("ABCDEF")


def test_pages_of_ten(spark):
    names = [f"P{i:02d}" for i in range(23)]
    ranked = leaderboard(bowling(spark, *({"bowler": n, "wickets": 1} for n in names)), BOWLING)
    assert [[r["bowler"] for r in dicts(page(ranked, n))] for n in (1, 2, 3, 4)] == [
        names[:10], names[10:20], names[20:], [],
    ]


def test_comparison_by_season(spark):
    table = bowling(
        spark,
        {"overs": 1.2, "bat_runs": 5, "wickets": 1},
        {"overs": 1.2, "bat_runs": 6, "stage": "Death"},
        {"overs": 3.0, "bat_runs": 7, "season": 2009},
        {"bowler": "B", "overs": 2.0, "bat_runs": 3},
        {"bowler": "C", "overs": 9.0},
    )
    rows = {(r["bowler"], r["season"]): r for r in dicts(compare_seasons(table, "A", "B"))}
    assert set(rows) == {("A", "2008"), ("A", "2009"), ("B", "2008")}
    assert rows["A", "2008"]["economy"] == 11 / 2.4 and rows["A", "2009"]["bow_avg"] == math.inf
    assert compare_players(table, "A", "B").columns == ["bowler", "season", "overs", "wickets"]
    assert compare_players(table, "A", "A", "economy", "economy").columns == ["bowler", "season", "economy"]


def test_choices(spark):
    table = bowling(spark, {"bowler": "B"}, {}, {"stage": "Death"})
    assert sorted(r["bowler"] for r in dicts(player_choices(table))) == ["A", "A", "B"]
    assert [r["bowler"] for r in dicts(player_choices(table, repeats=False))] == ["A", "B"]
    assert BOWLING.metrics == tuple(BOWLING_MART.names[i - 1] for i in (5, 7, 8, 9, 10, 12, 13, 14, 15, 16))
    assert BATTING.metrics == tuple(BATTING_MART.names[i - 1] for i in range(7, 16))
    assert list(INNING_CHOICES) == ["1", "2", "1 & 2"] and len(STAGE_CHOICES) == 4
