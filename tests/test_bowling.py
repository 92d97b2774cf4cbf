"""Hand-written cases, each through the single measures, the one-pass summary and the mart."""

import pytest

from balls import ball, by_player, deliveries, dicts, in_one_table, matches, one, out
from wicketworks.functions import with_stage
from wicketworks.operators import bowling
from wicketworks.operators.combine import combine
from wicketworks.operators.merge import merge_all
from wicketworks.plans import bowling_mart
from wicketworks.plans.marts import BOWLING_KEYS

pytestmark = pytest.mark.usefixtures("tiny_plans")

ANY = {"max_excluded_overs": -1}

CASES = {
    "mixed": ball(7) + ball(3, extra_runs=1),
    "six": ball(6),
    "seven": ball(7),
    "short": ball(5),
    "extra": ball(5) + ball(extra_runs=1),
    "overs": ball(6, over=1) + ball(6, over=2) + ball(6, over=2, match_id=2),
    # The same over number of another match is another over.
    "two matches": ball(3, over=1) + ball(3, over=1, match_id=2),
    "unknown in over": ball(6) + ball(batsman_runs=None),
    "five": out() * 5,
    "four": out() * 4 + out(match_id=2) * 3,
    "split": out(over=3) * 3 + out(over=10) * 2,
    "kinds": [
        *(r for k in ("run out", "retired hurt", "obstructing the field", "", None) for r in ball(dismissal_kind=k)),
        *out("lbw"),
        *out("caught"),
        *out("caught and bowled"),
        *out("stumped"),
        *out("hit wicket"),
    ],
    "rated": ball(39, batsman_runs=1) + out(batsman_runs=4),
    "tie": ball(39, batsman_runs=1) + ball(batsman_runs=3, extra_runs=1),
    "wicketless": ball(10, batsman_runs=1),
    "unknown": ball(4, batsman_runs=2) + ball(batsman_runs=None) + ball(extra_runs=1, match_id=2),
}


@pytest.fixture(scope="module")
def rows(spark):
    """Mart rows by bowler and stage, checked to be the same in all three shapes."""
    balls, games = deliveries(spark, in_one_table(CASES)), matches(spark)
    facts = with_stage(combine(balls, games)).cache()
    found = by_player(bowling_mart(balls, games, **ANY), "bowler")
    merged = bowling.finish_bowling(merge_all(bowling.bowling_measures(facts, BOWLING_KEYS)), BOWLING_KEYS)
    assert by_player(merged, "bowler") == found
    assert by_player(bowling.bowling_summary(facts, BOWLING_KEYS), "bowler") == found
    facts.unpersist()
    return found


def values(rows, case, *columns, stage="Powerplay"):
    row = rows[f"{case}:Bowler", stage]
    return row[columns[0]] if len(columns) == 1 else tuple(row[c] for c in columns)


def test_every_delivery_counts_as_a_ball(rows):
    assert values(rows, "mixed", "balls", "overs", "dotballs", "extra_runs") == (10, 1.7, 7, 3)
    assert values(rows, "mixed", "per_dotball") == 70.0


@pytest.mark.parametrize(
    "case, maidens",
    [
        ("six", 1),
        ("seven", 1),
        ("short", 0),
        ("extra", 0),
        ("overs", 3),
        ("two matches", 0),
        ("unknown in over", 0),
    ],
)
def test_maidens(rows, case, maidens):
    assert values(rows, case, "maiden") == maidens


def test_hauls_are_counted_per_match_inside_a_stage(rows):
    assert values(rows, "five", "wickets", "fivewicket", "fourwicket") == (5, 1, 1)
    assert values(rows, "four", "wickets", "fivewicket", "fourwicket", "matches") == (7, 0, 1, 2)
    for stage in ("Powerplay", "Middle"):
        assert values(rows, "split", "fivewicket", "fourwicket", stage=stage) == (0, 0)


def test_dismissals_credited_to_the_bowler(rows):
    assert values(rows, "kinds", "wickets", "balls") == (5, 10)


def test_ratios(rows):
    # 43 runs, 40 balls, one wicket.
    assert values(rows, "rated", "bow_avg", "economy", "overs") == (43.0, 6.4, 6.7)
    # 42 runs off 40 balls: 6.3 an over.
    assert values(rows, "tie", "bat_runs", "economy") == (42, 6.3)
    assert values(rows, "wicketless", "bow_avg", "economy") == (0.0, 6.0)


def test_one_unknown_run_makes_the_sum_zero(rows):
    assert values(rows, "unknown", "balls", "bat_runs", "extra_runs", "economy") == (6, 0, 1, 0.0)


def test_credited_kinds_are_a_parameter(spark):
    balls = deliveries(spark, out("run out"), out("lbw"))
    assert one(bowling_mart(balls, matches(spark), kinds=["run out"], **ANY))["wickets"] == 1


def test_a_missing_match_counts_as_a_match(spark):
    facts = combine(deliveries(spark, ball(2)), matches(spark))
    with_gap = facts.unionByName(facts.selectExpr("cast(null as bigint) as match_id", *facts.columns[1:]))
    assert one(bowling.matches_bowled(with_gap))["matches"] == 2
    assert one(bowling.bowling_summary(with_gap))["matches"] == 2


def test_a_missing_inning_is_a_group_shown_as_0(spark):
    rows = dicts(bowling_mart(deliveries(spark, ball(6, inning=None), ball(6)), matches(spark), **ANY))
    assert {r["inning"] for r in rows} == {0, 1}
