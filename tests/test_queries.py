"""Every registered query against its DuckDB SQL, and what must hold for the marts."""

from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry_points
from compare import TESTDATA, bag, connect, duck_bag, duck_types, spark_bag, spark_types
from wicketworks.checks.oracles import statements
from wicketworks.checks.queries import registered

QUERIES = registered()
SQL = statements()
ORDERED = [n for n in QUERIES if n.startswith(("leaderboard_", "top6_", "page_2_"))]


# Python workers, and joins of all rows with all rows.
FORBIDDEN = ("Python", "Pandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin")


def run(spark, name: str, sf: str):
    """Types and rows of the query, in the order Spark gives them."""
    df = QUERIES[name](spark, f"{TESTDATA}/sf{sf}")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]
    return spark_types(df), df.columns, [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def results(spark):
    """All queries at sf 0.01, some at a time."""
    with ThreadPoolExecutor(6) as pool:
        futures = {name: pool.submit(run, spark, name, "0.01") for name in QUERIES}
    return futures


@pytest.fixture(scope="module")
def duck():
    con = connect(f"{TESTDATA}/sf0.01")
    yield con
    con.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_points.queries()) and set(SQL) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(results, duck, name):
    types, columns, rows = results[name].result()
    assert types == duck_types(duck, SQL[name])
    assert rows, "the query should find something at this scale"
    assert bag(columns, rows) == duck_bag(duck, SQL[name])


@pytest.mark.parametrize("name", ORDERED)
def test_ranked_order_equals_sql(results, duck, name):
    _, columns, rows = results[name].result()
    player = columns.index("batsman" if "batting" in name else "bowler")
    result = duck.execute(SQL[name])
    at = [d[0] for d in result.description].index(columns[player])
    assert [r[player] for r in rows] == [r[at] for r in result.fetchall()]


@pytest.mark.parametrize("name", ["bowling_mart", "batting_mart"])
def test_marts_at_a_larger_scale(spark, name):
    con = connect(f"{TESTDATA}/sf0.1")
    assert spark_bag(QUERIES[name](spark, f"{TESTDATA}/sf0.1")) == duck_bag(con, SQL[name])


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["bowler", "wickets"] and len(df.collect()) == 6


def as_dicts(results, name):
    _, columns, rows = results[name].result()
    return [dict(zip(columns, row)) for row in rows]


def test_bowling_invariants(results):
    mart = as_dicts(results, "bowling_mart")
    keys = {(r["bowler"], r["inning"], r["season"], r["stage"]) for r in mart}
    assert len(keys) == len(mart) == 999
    for r in mart:
        assert r["dotballs"] <= r["balls"] and r["maiden"] * 6 <= r["balls"]
        assert r["fivewicket"] <= r["fourwicket"] <= r["matches"] <= r["balls"]
        assert r["overs"] == round(r["balls"] / 6 * 10) / 10
    assert sum(r["balls"] for r in mart) == len(results["bowler_qualified"].result()[2]) == 48_194


def test_batting_invariants(results):
    mart = as_dicts(results, "batting_mart")
    keys = {(r["batsman"], r["inning"], r["season"], r["stage"]) for r in mart}
    assert len(keys) == len(mart) == 1_125
    for r in mart:
        assert 1 <= r["innings_played"] and r["boundries"] + r["sixes"] <= r["balls_faced"]
        assert r["centuries"] + r["half_centuries"] <= r["innings_played"]
        assert r["maximum_score"] <= r["runs_made"] <= 6 * r["balls_faced"]
    assert sum(r["balls_faced"] for r in mart) == len(results["batsman_qualified"].result()[2]) == 54_085


def test_shapes_agree(results):
    for name in ("bowling", "batting"):
        _, columns, rows = results[f"{name}_mart"].result()
        _, others, stacked = results[f"{name}_stage_union"].result()
        assert bag(columns, rows) == bag(others, stacked)


def test_missing_values_show_up(results):
    for name, player, sums in (("bowling", "bowler", "bat_runs"), ("batting", "batsman", "runs_made")):
        mart = as_dicts(results, f"{name}_mart_missing")
        assert {r[player] is None for r in mart} == {True, False}
        assert {0, 1, 2} <= {r["inning"] for r in mart} and {0, 2008} <= {r["season"] for r in mart}
        assert any(r[sums] == 0 and r["boundries" if name == "batting" else "balls"] > 0 for r in mart)
    assert any(r["runs"] is None for r in as_dicts(results, "batsman_volume_missing"))
