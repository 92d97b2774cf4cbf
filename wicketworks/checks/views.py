"""Ball and match tables derived from the ``lineitem`` and ``orders`` test tables.

The expressions are integer arithmetic that Spark and DuckDB both run. They are fixed values of
the test fixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_MATCH_OF = "cast(floor({key} / 120) as bigint)"
_SEASON_OF = "cast(2008 + floor(floor({key} / 120) / 42) as int)"

MATCH_COLUMNS = {
    "id": _MATCH_OF.format(key="o_orderkey"),
    "season": _SEASON_OF.format(key="o_orderkey"),
}

# Names for parts of a row, used by the columns below.
BALL_PARTS = {
    "rowno": "l_orderkey * 10 + l_linenumber",
    "m": _MATCH_OF.format(key="l_orderkey"),
    "i": "case when l_linenumber = 7 then 3 when l_linenumber % 2 = 1 then 1 else 2 end",
    "o": "cast(1 + l_partkey % 20 as int)",
    "q": "cast(l_quantity as int)",
    "d": "cast(round(l_discount * 100) as int)",
    "t": "cast(round(l_tax * 100) as int)",
    "k": "cast(l_suppkey % 4 as int)",
    "rf": "l_returnflag",
}

# Numbers of the players, runs and the kind of dismissal, carried on to the names.
BALL_NUMBERS = {
    "rowno": "rowno",
    "match_id": "m",
    "inning": "i",
    "over": "o",
    "bowler_no": """case when o % 5 = 0 then 37 + (m * 5 + i * 3 + o) % 61
    else (m * 5 + i * 3 + o % 5) % 37 end""",
    "striker_no": """case when o >= 19 then 41 + (m * 7 + i * 2 + case when k = 0 then 1 else 0 end) % 53
    when o = 12 and k = 2 then 95
    else (m * 7 + i * 11 + cast(floor(o / 5) as int) + case when k = 0 then 1 else 0 end) % 41 end""",
    "non_striker_no": """case when o >= 19 and k = 0 then 41 + (m * 7 + i * 2) % 53
    when o = 3 and k = 2 then 95
    when o = 9 and k = 1 then 41 + (m * 7 + i * 2) % 53
    else (m * 7 + i * 11 + cast(floor(o / 5) as int) + case when k = 0 then 0 else 1 end) % 41 end""",
    "batsman_runs": """case when q <= 22 then 0 when q <= 36 then 1 when q <= 40 then 2
    when q <= 46 then 4 else 6 end""",
    "extra_runs": "case when d = 10 and q > 22 then 1 else 0 end",
    "dismissal_kind": """case
    when not ((t = 8 and q <= 22) or (t >= 5 and q <= 30 and m % 5 = 0 and o % 5 = 2)) then ''
    when d <= 3 then 'caught' when d <= 5 then 'bowled' when d = 6 then 'lbw' when d = 7 then 'run out'
    when d = 8 then 'stumped' when d = 9 then 'caught and bowled'
    when rf = 'A' then 'hit wicket' when rf = 'N' then 'retired hurt' else 'obstructing the field' end""",
}

BALL_COLUMNS = {
    "rowno": "rowno",
    "match_id": "match_id",
    "inning": "inning",
    "over": "over",
    "batsman": "concat('Batter ', striker_no)",
    "non_striker": "concat('Batter ', non_striker_no)",
    "bowler": "concat('Bowler ', bowler_no)",
    "batsman_runs": "batsman_runs",
    "extra_runs": "extra_runs",
    "total_runs": "batsman_runs + extra_runs",
    "dismissal_kind": "dismissal_kind",
    "player_dismissed": """case dismissal_kind when '' then ''
    when 'run out' then concat('Batter ', non_striker_no) else concat('Batter ', striker_no) end""",
}


# Rows of the fixture whose value is missing, by column. Runs are missing less often, since one makes a sum missing.
MISSING_BALLS = {
    "inning": "rowno % 89 = 1",
    "over": "rowno % 83 = 2",
    "batsman": "rowno % 79 = 3",
    "non_striker": "rowno % 73 = 4",
    "bowler": "rowno % 71 = 5",
    "batsman_runs": "rowno % 1009 = 6",
    "extra_runs": "rowno % 1013 = 7",
    "total_runs": "rowno % 1019 = 8",
    "dismissal_kind": "rowno % 67 = 9",
    "player_dismissed": "rowno % 61 = 10",
}
MISSING_MATCHES = {"season": "id % 5 = 3"}


def _with_missing(columns: dict[str, str], missing: dict[str, str]) -> list[str]:
    return [f"case when {missing[c]} then null else {c} end as {c}" if c in missing else c for c in columns]


def _aliased(columns: dict[str, str]) -> list[str]:
    return [f"{expression} as {name}" for name, expression in columns.items()]


def numbered_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ball table with ``rowno``, its order in the fixture."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    numbers = lines.selectExpr(*_aliased(BALL_PARTS)).selectExpr(*_aliased(BALL_NUMBERS))
    return numbers.selectExpr(*_aliased(BALL_COLUMNS))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_deliveries(spark, sf_dir).drop("rowno")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*_aliased(MATCH_COLUMNS)).distinct()


def missing_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ball table with values missing in every column but the match."""
    return numbered_deliveries(spark, sf_dir).selectExpr(*_with_missing(BALL_COLUMNS, MISSING_BALLS)).drop("rowno")


def missing_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match table with seasons missing."""
    return matches(spark, sf_dir).selectExpr(*_with_missing(MATCH_COLUMNS, MISSING_MATCHES))


def sql_missing_views() -> str:
    """The tables with missing values, on top of ``sql_views``."""
    balls, games = ", ".join(_with_missing(BALL_COLUMNS, MISSING_BALLS)), ", ".join(_with_missing(MATCH_COLUMNS, MISSING_MATCHES))
    return f"missing_deliveries as (select {balls} from deliveries),\nmissing_matches as (select {games} from matches)"


def sql_views() -> str:
    """The same tables as common table expressions, for DuckDB."""
    parts = ",\n  ".join(_aliased(BALL_PARTS))
    numbers = ",\n  ".join(_aliased(BALL_NUMBERS))
    balls = ",\n  ".join(_aliased(BALL_COLUMNS))
    ids = ", ".join(_aliased(MATCH_COLUMNS))
    return (
        f"parts as (select\n  {parts}\n  from lineitem),\n"
        f"numbers as (select\n  {numbers}\n  from parts),\n"
        f"deliveries as (select\n  {balls}\n  from numbers),\n"
        f"matches as (select distinct {ids} from orders)"
    )
