"""Random balls with values missing everywhere: the marts against the tables merged measure by measure."""

import random

import pytest

from balls import deliveries, matches
from compare import spark_bag
from wicketworks.functions import with_stage
from wicketworks.operators import batting, bowling
from wicketworks.operators.combine import combine
from wicketworks.operators.merge import merge_all
from wicketworks.operators.qualify import (
    batsman_exclusions,
    bowler_exclusions,
    qualified_batting,
    qualified_bowling,
)
from wicketworks.plans import batting_mart, bowling_mart
from wicketworks.plans.marts import BATTING_KEYS, BOWLING_KEYS, excluded_batsmen

pytestmark = pytest.mark.usefixtures("tiny_plans")

SEASONS = {m: 2008 + m % 2 for m in range(1, 7)}


def random_balls(seed: int, n: int, missing: float) -> list[dict]:
    draw = random.Random(seed)

    def maybe(value):
        return None if draw.random() < missing else value

    rows = []
    for _ in range(n):
        # Few low player numbers are frequent, many high ones are rare and get excluded.
        batsman, partner, bowler = (int(draw.paretovariate(0.7)) % 40 for _ in range(3))
        runs, extra = draw.choice((0, 0, 0, 1, 2, 4, 6)), draw.choice((0, 0, 0, 1))
        is_out = draw.random() < 0.1
        rows.append(
            {
                "match_id": draw.choice(list(SEASONS)),
                "inning": maybe(draw.randint(1, 3)),
                "over": maybe(draw.randint(1, 21)),
                "batsman": maybe(f"P{batsman}"),
                "non_striker": maybe(f"P{partner}"),
                "bowler": maybe(f"P{bowler}"),
                "batsman_runs": maybe(runs),
                "extra_runs": maybe(extra),
                "total_runs": maybe(runs + extra),
                "dismissal_kind": maybe(draw.choice(("caught", "run out", "lbw")) if is_out else ""),
                "player_dismissed": maybe(f"P{draw.choice((batsman, partner, 99))}" if is_out else ""),
            }
        )
    return rows


@pytest.mark.parametrize("seed, missing", [(1, 0.0), (2, 0.02), (3, 0.2)])
def test_marts_equal_merged_measures(spark, seed, missing):
    balls, games = deliveries(spark, random_balls(seed, 2_500, missing)).cache(), matches(spark, SEASONS)
    facts = combine(balls, games)

    low_bowlers = bowler_exclusions(facts, 5)
    kept = with_stage(qualified_bowling(facts, low_bowlers)).cache()
    merged = bowling.finish_bowling(merge_all(bowling.bowling_measures(kept, BOWLING_KEYS)), BOWLING_KEYS)
    mart = spark_bag(bowling_mart(balls, games, max_excluded_overs=5))
    assert low_bowlers.count() and mart == spark_bag(merged)

    low_batsmen = batsman_exclusions(facts, 30).cache()
    kept = with_stage(qualified_batting(facts, low_batsmen)).cache()
    measures = batting.batting_measures(kept, low_batsmen, BATTING_KEYS)
    merged = batting.finish_batting(merge_all(measures), BATTING_KEYS)
    mart = spark_bag(batting_mart(balls, games, max_excluded_balls=30))
    assert low_batsmen.count() and mart == spark_bag(merged)
    assert spark_bag(excluded_batsmen(balls, games, 30)) == spark_bag(low_batsmen.select("batsman", "season"))
    spark.catalog.clearCache()
