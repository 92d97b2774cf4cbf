"""Hand-written cases, each through the single measures, the one-pass summary and the mart."""

import pytest

from balls import ball, by_player, deliveries, in_one_table, matches, out
from wicketworks.functions import with_stage
from wicketworks.operators import batting
from wicketworks.operators.combine import combine
from wicketworks.operators.merge import merge_all
from wicketworks.operators.qualify import batsman_exclusions, qualified_batting
from wicketworks.plans import batting_mart
from wicketworks.plans.marts import BATTING_KEYS

pytestmark = pytest.mark.usefixtures("tiny_plans")

CASES = {
    "shots": ball(3, batsman_runs=4) + ball(2, batsman_runs=6) + ball(2) + ball(extra_runs=4),
    "49": ball(49, batsman_runs=1),
    "50": ball(50, batsman_runs=1),
    "99": ball(99, batsman_runs=1),
    "100": ball(100, batsman_runs=1),
    "stages": ball(60, batsman_runs=1) + ball(60, batsman_runs=1, over=9),
    "matches": ball(30, batsman_runs=1) + ball(70, batsman_runs=1, match_id=2),
    "out": out("bowled") + out("retired hurt", match_id=2) + ball(match_id=3, batsman_runs=6),
    "never out": ball(15, batsman_runs=1) + ball(15, batsman_runs=1, match_id=2),
    "both ends": ball(2) + ball(2, batsman="Partner", non_striker="Striker"),
    "runner": out("obstructing the field", player="Runner"),
    "unknown": [
        *ball(100, batsman_runs=1),
        *ball(60, batsman_runs=1, match_id=2),
        *ball(batsman_runs=None, match_id=2),
    ],
    "no dismissal": ball(3, player_dismissed=None),
}


def three_ways(spark, balls, max_balls):
    """Mart rows by batsman and stage, checked to be the same in all three shapes."""
    games = matches(spark)
    facts = combine(balls, games)
    exclusions = batsman_exclusions(facts, max_balls).cache()
    kept = with_stage(qualified_batting(facts, exclusions)).cache()
    found = by_player(batting_mart(balls, games, max_excluded_balls=max_balls), "batsman")
    merged = merge_all(batting.batting_measures(kept, exclusions, BATTING_KEYS))
    assert by_player(batting.finish_batting(merged, BATTING_KEYS), "batsman") == found
    assert by_player(batting.batting_summary(kept, exclusions, BATTING_KEYS), "batsman") == found
    kept.unpersist()
    exclusions.unpersist()
    return found


@pytest.fixture(scope="module")
def rows(spark):
    return three_ways(spark, deliveries(spark, in_one_table(CASES)), -1)


def values(rows, case, *columns, player="Striker", stage="Powerplay"):
    row = rows[f"{case}:{player}", stage]
    return row[columns[0]] if len(columns) == 1 else tuple(row[c] for c in columns)


def test_runs_balls_and_shots(rows):
    assert values(rows, "shots", "runs_made", "balls_faced", "boundries", "sixes") == (24, 8, 3, 2)
    assert values(rows, "shots", "strike_rate") == 300.0


@pytest.mark.parametrize("score, centuries, halves", [(49, 0, 0), (50, 0, 1), (99, 0, 1), (100, 1, 0)])
def test_milestones(rows, score, centuries, halves):
    found = values(rows, str(score), "centuries", "half_centuries", "maximum_score")
    assert found == (centuries, halves, score)


def test_milestones_are_counted_per_match_inside_a_stage(rows):
    for stage in ("Powerplay", "Middle"):
        assert values(rows, "stages", "centuries", "half_centuries", stage=stage) == (0, 1)
    found = values(rows, "matches", "centuries", "half_centuries", "maximum_score", "innings_played")
    assert found == (0, 1, 70, 2)


def test_dismissals_count_whatever_the_kind(rows):
    found = values(rows, "out", "dismissed", "innings_played", "not_out", "batting_avg")
    assert found == (2, 3, 1, 3.0)


def test_never_out_has_no_average_and_no_not_outs(rows):
    found = values(rows, "never out", "dismissed", "innings_played", "not_out", "batting_avg")
    assert found == (0, 2, 0, 0.0)


def test_only_at_the_other_end(rows):
    columns = ("innings_played", "runs_made", "balls_faced", "maximum_score", "strike_rate")
    assert values(rows, "49", *columns, player="Partner") == (1, 0, 0, 0, 0.0)


def test_both_ends_in_one_match_is_one_innings(rows):
    for player in ("Striker", "Partner"):
        assert values(rows, "both ends", "innings_played", player=player) == 1


def test_the_dismissed_need_an_innings_of_their_own(rows):
    assert ("runner:Striker", "Powerplay") in rows
    assert ("runner:Runner", "Powerplay") not in rows


def test_unknown_runs(rows):
    # The sum and the best score are unknown, the match with known runs still counts.
    columns = ("runs_made", "maximum_score", "centuries", "half_centuries", "balls_faced")
    assert values(rows, "unknown", *columns) == (0, 0, 1, 0, 161)


def test_missing_dismissal(rows):
    assert values(rows, "no dismissal", "dismissed") == 0


def test_balls_of_an_excluded_striker_count_for_nobody(spark):
    balls = deliveries(
        spark,
        ball(100, batsman="Good", non_striker="Tail"),
        out("run out", player="Good", batsman="Tail", non_striker="Good", match_id=2),
        ball(5, batsman="Tail", non_striker="Guest", match_id=2),
        ball(95, batsman="Open", non_striker=None),
    )
    rows = three_ways(spark, balls, 90)
    # Tail is excluded, also where at the other end; Guest was only seen with Tail.
    assert {k[0] for k in rows} == {"Good", "Open", None}
    row = rows["Good", "Powerplay"]
    assert (row["dismissed"], row["innings_played"]) == (0, 1)
