"""Physical plans: scans, exchanges, joins by size, skew and bucketed inputs."""

import pytest
from pyspark.sql import functions as F

from compare import TESTDATA, bag, spark_bag
from wicketworks.checks import views
from wicketworks.checks.queries import registered
from wicketworks.functions import natural_full_join
from wicketworks.operators.merge import merge_all
from wicketworks.operators.qualify import (
    batsman_exclusions,
    bowler_exclusions,
    qualified_batting,
    qualified_bowling,
)
from wicketworks.plans import batting_mart, bowling_mart, leaderboard
from wicketworks.plans.facts import batting_facts, bowling_facts
from wicketworks.plans.marts import excluded_batsmen
from wicketworks.schema import BATTING, BATTING_MART, BOWLING, BOWLING_MART
from wicketworks.session import shuffle_partitions
from wicketworks.sources import read_mart, write_mart

SF = f"{TESTDATA}/sf0.01"
NO_BROADCAST = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark):
    return views.deliveries(spark, SF), views.matches(spark, SF)


def ball_scans(plan: str) -> list[str]:
    return [line for line in plan.splitlines() if "FileScan" in line and "l_linenumber" in line]


def way_up(plan: str, start: int) -> list[str]:
    """Operators above a line of the plan, nearest first."""
    lines = plan.splitlines()

    def depth(line: str) -> int:
        return len(line) - len(line.lstrip(" :+-"))

    level, above = depth(lines[start]), []
    for line in reversed(lines[:start]):
        if depth(line) < level:
            level = depth(line)
            above.append(line.lstrip(" :+-*()0123456789"))
    return above


@pytest.mark.parametrize("mart, scans", [(bowling_mart, 1), (batting_mart, 2)])
def test_balls_are_added_up_before_they_are_moved(spark, mart, scans):
    plan = plan_of(mart(*tables(spark)))
    assert len(ball_scans(plan)) == scans
    for number, line in enumerate(plan.splitlines()):
        if line in ball_scans(plan):
            above = way_up(plan, number)
            first_exchange = next(i for i, op in enumerate(above) if op.startswith("Exchange"))
            assert any(op.startswith("HashAggregate") for op in above[:first_exchange])
            assert not any("Join" in op for op in above[:first_exchange])
    # The window only sees one row per inning and stage of a player-season.
    assert "Exchange SinglePartition" not in plan


def test_scans_read_the_needed_columns_only(spark):
    def columns(df):
        return [line.split("FileScan parquet [")[1].split("]")[0] for line in ball_scans(plan_of(df))]

    read = {c.split("#")[0] for c in columns(bowling_mart(*tables(spark)))[0].split(",")}
    assert read == {"l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag"}
    narrowest = min(columns(batting_mart(*tables(spark))), key=len)
    assert {c.split("#")[0] for c in narrowest.split(",")} == {
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    }


def test_top_lists_and_pages_are_not_sorted_as_a_whole(spark):
    for name in ("top6_bowling_economy", "top6_batting_sixes", "page_2_bowling"):
        assert "TakeOrderedAndProject" in plan_of(registered()[name](spark, SF))


def test_requests_read_one_season_of_the_written_mart(spark, tmp_path):
    for mart, schema, discipline in (
        (bowling_mart, BOWLING_MART, BOWLING),
        (batting_mart, BATTING_MART, BATTING),
    ):
        path = str(tmp_path / discipline.player)
        built = mart(*tables(spark))
        write_mart(built, path)
        stored = read_mart(spark, path, schema)
        ranked = leaderboard(stored, discipline, 2009)
        assert spark_bag(ranked) == spark_bag(leaderboard(built, discipline, 2009))
        assert "(season" in plan_of(ranked).split("PartitionFilters: [")[1].split("]")[0]


def test_joins_without_broadcast_give_the_same_marts(spark, conf):
    expected = [spark_bag(mart(*tables(spark))) for mart in (bowling_mart, batting_mart)]
    conf(**NO_BROADCAST)
    for mart, rows in zip((bowling_mart, batting_mart), expected):
        df = mart(*tables(spark))
        assert spark_bag(df) == rows
        assert "BroadcastHashJoin" not in plan_of(df) and "SortMergeJoin" in plan_of(df)


def test_a_stored_exclusion_list_is_broadcast_only_while_small(spark, conf, tmp_path):
    balls, games = tables(spark)
    path = str(tmp_path / "excluded")
    excluded_batsmen(balls, games).write.parquet(path)
    expected = spark_bag(batting_mart(balls, games))

    def mart():
        return batting_mart(balls, games, excluded=spark.read.parquet(path))

    def moved(df):
        return [line for line in plan_of(df).splitlines() if "Exchange hash" in line and "coalesce(batsman" in line]

    small = mart()
    assert not moved(small) and spark_bag(small) == expected
    conf(**NO_BROADCAST)
    large = mart()
    assert len(moved(large)) == 1 and spark_bag(large) == expected


@pytest.fixture
def skewed(spark, tmp_path):
    """One player bats and bowls two thirds of all balls."""
    n = 240_000
    hot = F.col("id") % 3 != 0
    balls = spark.range(n, numPartitions=12).select(
        (F.col("id") % 3000).alias("match_id"),
        (1 + F.col("id") % 2).cast("int").alias("inning"),
        (1 + F.floor(F.col("id") / 7) % 20).cast("int").alias("over"),
        F.when(hot, "Hot").otherwise(F.concat(F.lit("P"), F.col("id") % 2999)).alias("batsman"),
        F.concat(F.lit("P"), (F.col("id") + 1) % 2999).alias("non_striker"),
        F.when(hot, "Hot").otherwise(F.concat(F.lit("B"), F.col("id") % 997)).alias("bowler"),
        (F.col("id") % 7).cast("int").alias("batsman_runs"),
        F.lit(0).alias("extra_runs"),
        (F.col("id") % 7).cast("int").alias("total_runs"),
        F.when(F.col("id") % 31 == 0, "caught").otherwise("").alias("dismissal_kind"),
        F.when(F.col("id") % 31 == 0, F.col("batsman")).otherwise("").alias("player_dismissed"),
    )
    path = str(tmp_path / "balls.parquet")
    balls.write.parquet(path)
    games = spark.range(3000).select("id", (2008 + F.col("id") % 2).cast("int").alias("season"))
    return spark.read.parquet(path), games


SPLIT_SKEW = {
    **NO_BROADCAST,
    "spark__sql__shuffle__partitions": "16",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "20KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "3",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "10KB",
}


def test_a_hot_striker_is_split_in_the_join_with_the_exclusions(spark, conf, skewed):
    expected = spark_bag(batting_mart(*skewed))
    conf(**SPLIT_SKEW)
    df = batting_mart(*skewed)
    assert spark_bag(df) == expected
    assert "SortMergeJoin(skew=true)" in plan_of(df)


PLAYER_FACTS = {
    "bowler": (bowling_facts, bowler_exclusions, qualified_bowling, {"max_excluded_overs": 20}, 20),
    "batsman": (batting_facts, batsman_exclusions, qualified_batting, {"max_excluded_balls": 40}, 40),
}


def moves_of_balls(plan: str, scan: str) -> list[str]:
    """Exchanges that rows of a scan pass before they are added up."""
    lines, moves = plan.splitlines(), []
    for number, line in enumerate(lines):
        if scan in line and "Scan" in line:
            above = way_up(plan, number)
            end = next((i for i, op in enumerate(above) if "Aggregate" in op), len(above))
            moves += [op for op in above[:end] if op.startswith("Exchange")]
    return moves


@pytest.mark.parametrize("player", PLAYER_FACTS)
def test_no_ball_is_moved_by_player_to_be_qualified(spark, conf, skewed, player, tmp_path):
    """Two thirds of the balls have one player; each way of qualifying gives the same balls."""
    balls, games = skewed
    build, listed, qualify, options, limit = PLAYER_FACTS[player]
    facts = balls.join(games.withColumnRenamed("id", "match_id"), "match_id")
    exclusions = listed(facts, limit)

    def digest(df):
        return spark_bag(df.groupBy(player, "season").agg(F.count("*"), F.sum(F.hash("match_id", "over", "batsman")).alias("x")))

    low = exclusions.select(player, "season")
    expected = digest(facts.join(low, [player, "season"], "left_anti"))
    assert len(expected) < facts.select(player, "season").distinct().count()
    conf(**NO_BROADCAST)
    for df in (build(balls, games, **options), qualify(facts, exclusions)):
        plan = plan_of(df)
        moves = moves_of_balls(plan, "batsman_runs")
        assert moves and not [m for m in moves if f"{player}#" in m.split("]")[0]]
        assert all("hashpartitioning(match_id" in m for m in moves)
        assert digest(df) == expected
    conf(spark__sql__autoBroadcastJoinThreshold="10m")
    stored = build(balls, games, **options, store=str(tmp_path / "listed"))
    assert not moves_of_balls(plan_of(stored), "batsman_runs") and digest(stored) == expected
    exclusions.write.parquet(str(tmp_path / "exclusions"))
    small = qualify(facts, spark.read.parquet(str(tmp_path / "exclusions")))
    assert "LeftAnti" in plan_of(small) and digest(small) == expected


def test_balls_without_a_match_are_qualified_too(spark, conf):
    rows = [(m, f"P{i % 5}" if i % 7 else None, 2008 if i % 3 else None, i) for i in range(100) for m in (1, 2, None)]
    facts = spark.createDataFrame(rows, "match_id int, bowler string, season int, over int")
    low = [("P1", 2008), ("P2", None), (None, 2008), (None, None)]
    exclusions = spark.createDataFrame(low, "bowler string, season int")
    conf(**NO_BROADCAST)
    assert spark_bag(qualified_bowling(facts, exclusions)) == bag(facts.columns, [r for r in rows if (r[1], r[2]) not in low])


def test_requests_for_a_season_drop_the_other_balls_first(spark, conf, skewed, tmp_path):
    balls, games = skewed
    games.write.parquet(str(tmp_path / "games"))
    games = spark.read.parquet(str(tmp_path / "games"))
    for mart in (bowling_mart, batting_mart):
        expected = spark_bag(mart(balls, games).where("season = 2008"))
        df = mart(balls, games, season=2008)
        plan = plan_of(df)
        assert spark_bag(df) == expected and "EqualTo(season,2008)" in plan
        for number, line in enumerate(plan.splitlines()):
            if "FileScan" in line and "batsman#" in line:
                above = way_up(plan, number)
                first = next(i for i, op in enumerate(above) if "Aggregate" in op)
                assert any("LeftSemi" in op for op in above[:first]) and not any(op.startswith("Exchange") for op in above[:first])
        conf(spark__sql__autoBroadcastJoinThreshold="1k")  # more ids than that: balls are added up first
        large = mart(balls, games, season=2008)
        assert "LeftSemi" not in plan_of(large) and "EqualTo(season,2008)" in plan_of(large) and spark_bag(large) == expected
        conf(spark__sql__autoBroadcastJoinThreshold="10m")


def test_merged_measures_and_unions_come_from_one_rollup(spark):
    for name, most in (("bowling_merge_all", 1), ("batting_merge_all", 2), ("bowling_stage_union", 2), ("batting_stage_union", 2)):
        plan = plan_of(registered()[name](spark, SF))
        assert 1 <= len(ball_scans(plan)) <= most and "FullOuter" not in plan


def test_tables_are_merged_in_one_exchange(spark):
    keys = "k int, n string, "
    one = spark.createDataFrame([(1, "a", 5), (1, None, None), (None, None, 7)], keys + "x int")
    two = spark.createDataFrame([(1, "a", 0.5), (2, "b", None), (None, None, 1.5)], keys + "y double")
    three = spark.createDataFrame([(1, None, "p"), (3, "c", "q")], keys + "z string")
    merged = merge_all([one, two, three])
    plan = plan_of(merged)
    assert plan.count("Exchange") == 1 and "Join" not in plan and merged.columns == ["k", "n", "x", "y", "z"]
    assert spark_bag(merged) == spark_bag(natural_full_join(natural_full_join(one, two), three))
    with pytest.raises(Exception, match="occurs twice"):
        merge_all([one, two.union(two)]).collect()
    chain = [one, two.withColumnRenamed("n", "m"), three]  # other columns in common: joined one by one
    assert spark_bag(merge_all(chain)) == spark_bag(natural_full_join(natural_full_join(*chain[:2]), three))


def test_a_hot_bowler_is_spread_over_the_tasks_of_the_first_exchange(spark, conf, skewed):
    """The largest exchange hashes match and over too: no task gets much more than its share."""
    from wicketworks.operators.bowling import over_totals

    conf(spark__sql__shuffle__partitions="16", spark__sql__adaptive__coalescePartitions__enabled="false")
    totals = over_totals(skewed[0], ["bowler", "inning"])
    sizes = [r["count"] for r in totals.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1.3 * sum(sizes) / 16


def test_bucketed_balls_are_not_moved_before_the_player_totals(spark, conf):
    conf(**NO_BROADCAST)
    balls, games = tables(spark)
    balls.write.mode("overwrite").bucketBy(4, "match_id").sortBy("match_id").saveAsTable("bucketed_balls")
    games.write.mode("overwrite").bucketBy(4, "id").sortBy("id").saveAsTable("bucketed_games")
    df = bowling_mart(spark.table("bucketed_balls"), spark.table("bucketed_games"))
    plan = plan_of(df)
    # One exchange of player totals, one for the season window; join and match totals need none.
    assert plan.count("Exchange hashpartitioning") == 2
    assert "match_id" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    assert spark_bag(df) == spark_bag(bowling_mart(balls, games))


def test_shuffle_partitions_follow_the_data():
    assert shuffle_partitions(0, 8) == 16
    assert shuffle_partitions(10 * 1024**4, 4000) == 54_614
