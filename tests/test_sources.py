import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from balls import ball, deliveries, dicts, matches, out
from compare import TESTDATA, spark_bag
from wicketworks.checks import views
from wicketworks.functions import stage_of
from wicketworks.operators.batting import partnership_totals
from wicketworks.operators.bowling import over_totals
from wicketworks.operators.distinct import first_seen, pick_positions, values_at
from wicketworks.operators.lattice import lattice
from wicketworks.operators.ranking import metric_table, page, page_after
from wicketworks.plans import (
    batting_mart,
    bowling_mart,
    build,
    build_marts,
    compare_seasons,
    leaderboard,
    open_lattices,
    open_marts,
)
from wicketworks.plans.rollup import OVER, OVER_MEASURES, PARTNERSHIP, PARTNERSHIP_MEASURES, grain, match_rollup
from wicketworks.schema import BATTING, BATTING_MART, BOWLING, BOWLING_MART, DELIVERIES, MATCHES, STAGE_CHOICES
from wicketworks.sources import (
    read_csv,
    read_deliveries,
    read_mart,
    read_matches,
    reject_count,
    rejected,
    write_mart,
)

HEADER = (
    "venue,match_id,inning,over,batsman,non_striker,bowler,batsman_runs,extra_runs,total_runs,"
    "player_dismissed,dismissal_kind,fielder\n"
)


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_columns_by_name_blanks_and_na(spark, tmp_path):
    path = write(
        tmp_path / "deliveries.csv",
        HEADER
        + 'Eden,1,1,1,A,B,"C, Junior",4,0,4,,,\n'
        + 'Eden,1,1,1,A,NA,C,,0,NA,"","",x\n'
        + 'Eden,1,1,2,A,B,"The ""C""",1,0,1,A,caught,y\n',
    )
    df = read_deliveries(spark, path)
    assert df.schema == DELIVERIES
    rows = dicts(df)
    assert [r["bowler"] for r in rows] == ["C, Junior", "C", 'The "C"']
    assert [r["player_dismissed"] for r in rows] == ["", "", "A"]
    assert [r["dismissal_kind"] for r in rows] == ["", "", "caught"]
    assert [r["non_striker"] for r in rows] == ["B", None, "B"]
    assert [r["batsman_runs"] for r in rows] == [4, None, 1]
    assert [r["total_runs"] for r in rows] == [4, None, 1]


def test_csv_reads_only_the_wanted_columns(spark, tmp_path):
    path = write(tmp_path / "matches.csv", "id,city,season\n1,X,2008\n2,Y,2009\n")
    df = read_matches(spark, path)
    assert df.schema == MATCHES and len(df.collect()) == 2
    plan = df.select("season")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<season:string>" in plan


def test_csv_with_line_breaks_in_quotes(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'id,city,season\n1,"two\nlines",2008\n2,Y,2009\n')
    assert [r["season"] for r in dicts(read_csv(spark, path, MATCHES, multi_line=True))] == [2008, 2009]


def test_csv_files_must_agree_on_the_header(spark, tmp_path):
    write(tmp_path / "a.csv", "id,season\n1,2008\n")
    write(tmp_path / "b.csv", "season,id\n2008,2\n")
    with pytest.raises(Exception, match="header|CSV"):
        read_matches(spark, str(tmp_path)).collect()


def test_parquet_is_read_under_any_name(spark, tmp_path):
    for name in ("matches.parquet", "matches_dir"):
        path = str(tmp_path / name)
        spark.createDataFrame([("x", 2008, 1)], "city string, season bigint, id int").write.parquet(path)
        df = read_matches(spark, path, "parquet")
        assert dicts(df) == [{"id": 1, "season": 2008}] and df.schema == MATCHES


def test_formats_are_not_guessed(spark, tmp_path):
    csv = write(tmp_path / "m.csv", "id,season\n1,2008\n")
    with pytest.raises(ValueError, match="named as parquet"):
        read_matches(spark, [csv, str(tmp_path / "m.parquet")])
    with pytest.raises(ValueError, match="neither"):
        read_matches(spark, csv, "json")


def test_whole_numbers_in_any_notation(spark, tmp_path):
    texts = ["2008.0", " 2009", "1e3", "NA", "", "2008.5", "x", "9007199254740993"]
    path = write(tmp_path / "m.csv", "id,season\n" + "".join(f"{t},{t}\n" for t in texts))
    found = dicts(read_matches(spark, path))
    assert [r["id"] for r in found] == [2008, 2009, 1000, None, None, None, None, 9007199254740993]
    assert [r["season"] for r in found] == [2008, 2009, 1000, None, None, None, None, None]


def test_first_seen_follows_the_order_of_the_file(spark, tmp_path, conf):
    kinds = ["", "caught", "bowled", "run out", "lbw", "hit wicket", "stumped", "retired", "other", "late"]
    lines = [f"1,1,1,{k}" for k in kinds for _ in range(200)] + ["1,1,1,caught"] * 100
    path = write(tmp_path / "d.csv", "match_id,inning,over,dismissal_kind\n" + "\n".join(lines) + "\n")
    # Several tasks per file, so that place in the file and task order differ.
    conf(spark__sql__files__maxPartitionBytes="2048")
    schema = DELIVERIES.__class__([f for f in DELIVERIES if f.name in ("match_id", "dismissal_kind")])
    df = read_csv(spark, path, schema, row_order="place")
    assert df.rdd.getNumPartitions() > 3
    seen = first_seen(df, "dismissal_kind", F.col("place"))
    assert [r["dismissal_kind"] for r in seen.collect()] == kinds
    picked = {r["position"]: r["dismissal_kind"] for r in pick_positions(seen).collect()}
    assert picked == {p: kinds[p - 1] for p in (2, 3, 5, 6, 7, 9)}
    assert values_at(df, "dismissal_kind", F.col("place"), positions=(1, 4)) == ["", "run out"]


def test_marts_round_trip_and_prune_seasons(spark, tmp_path):
    seasons = {1: 2008, 2: 2009}
    balls = deliveries(
        spark,
        *(ball(160, match_id=m, over=o, batsman_runs=1) for m in seasons for o in (3, 9, 18)),
        *(out(match_id=m) for m in seasons),
    )
    for name, mart, schema in (
        ("bowling", bowling_mart(balls, matches(spark, seasons)), BOWLING_MART),
        ("batting", batting_mart(balls, matches(spark, seasons)), BATTING_MART),
    ):
        path = str(tmp_path / name)
        write_mart(mart, path)
        assert sorted(p for p in os.listdir(path) if "=" in p) == ["season=2008", "season=2009"]
        back = read_mart(spark, path, schema)
        assert back.dtypes == mart.dtypes
        assert spark_bag(back) == spark_bag(mart)
        plan = back.where("season = 2008")._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(season" in plan


def test_job_from_csv_to_marts(spark, tmp_path):
    """The generated tables written as CSV give the same marts as read from parquet."""
    sf_dir = f"{TESTDATA}/sf0.001"
    balls, games = views.deliveries(spark, sf_dir), views.matches(spark, sf_dir)
    for name, table in (("balls", balls), ("games", games)):
        table.write.option("header", True).csv(str(tmp_path / name))
    built = build_marts(spark, str(tmp_path / "balls"), str(tmp_path / "games"), str(tmp_path / "marts"))
    expected = bowling_mart(balls, games), batting_mart(balls, games)
    for stored, opened, mart in zip(built, open_marts(spark, str(tmp_path / "marts")), expected):
        assert spark_bag(stored) == spark_bag(opened) == spark_bag(mart)
    for stored, mart, discipline in zip(open_lattices(spark, str(tmp_path / "marts")), expected, (BOWLING, BATTING)):
        for inning in ("1", "2", "1 & 2", "other"):
            for stage in (*STAGE_CHOICES, "Death", "other"):
                metric = discipline.metrics[len(inning + stage) % len(discipline.metrics)]
                ranked = leaderboard(stored, discipline, 2008, inning, stage, metric)
                want = leaderboard(mart, discipline, 2008, inning, stage, metric)
                assert ranked.collect() == want.collect()
        plan = ranked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Exchange") == 1 and "Aggregate" not in plan and "PartitionFilters: [isnotnull(season" in plan
        assert "IsNotNull(stage_choice)" in plan and "IsNotNull(inning_choice)" in plan
        assert stored.dtypes == lattice(mart, discipline).dtypes
    compared = compare_seasons(built[0], "Bowler 5", "Bowler 21")
    assert "In(bowler, [Bowler 21,Bowler 5])" in compared._jdf.queryExecution().executedPlan().toString()


def jobs(spark, tmp_path, balls, games):
    """Writes the inputs of a build as CSV; their paths and that of the marts."""
    for name, table in (("balls", balls), ("games", games)):
        table.write.mode("overwrite").option("header", True).csv(str(tmp_path / name))
    return str(tmp_path / "balls"), str(tmp_path / "games"), str(tmp_path / "marts")


def test_one_rollup_gives_both_first_groupings_in_one_scan(spark, conf):
    balls = views.deliveries(spark, f"{TESTDATA}/sf0.01")
    rollup = match_rollup(balls)
    plan = rollup._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Expand" in plan
    assert spark_bag(grain(rollup, "over")) == spark_bag(over_totals(balls, ["bowler", "inning"]).select(*OVER, *OVER_MEASURES))
    staged = balls.withColumn("stage", stage_of())
    assert spark_bag(grain(rollup, "partnership")) == spark_bag(
        partnership_totals(staged, ["inning", "stage"]).select(*PARTNERSHIP, *PARTNERSHIP_MEASURES)
    )


def test_a_missing_bowler_is_not_taken_for_a_partnership(spark):
    balls = deliveries(spark, ball(2, bowler=None, batsman=None, over=None, batsman_runs=None))
    rows = {r["grain"]: r for r in dicts(match_rollup(balls))}
    assert set(rows) == {"over", "partnership"} and all(r["balls"] == 2 and r["unknown"] == 2 for r in rows.values())


def test_a_failed_build_leaves_the_last_one(spark, tmp_path, monkeypatch):
    seasons = {1: 2008, 2: 2009}
    some = deliveries(spark, ball(200, batsman_runs=1))
    paths = jobs(spark, tmp_path, some, matches(spark, seasons))
    first = [spark_bag(m) for m in build_marts(spark, *paths)]
    jobs(spark, tmp_path, deliveries(spark, ball(300, match_id=2)), matches(spark, seasons))

    def fails(*args, **options):
        raise RuntimeError("no space left")

    with monkeypatch.context() as m:
        m.setattr(build, "batting_totals_of", fails)
        with pytest.raises(RuntimeError):
            build_marts(spark, *paths)
    m = build.write_mart
    with monkeypatch.context() as patch:  # the new bowling is written, the new batting is not
        patch.setattr(build, "write_mart", lambda mart, path, **o: fails() if "batting" in path else m(mart, path, **o))
        with pytest.raises(RuntimeError):
            build_marts(spark, *paths)
    assert len(os.listdir(tmp_path / "marts" / "builds")) == 3
    assert [spark_bag(mart) for mart in open_marts(spark, paths[2])] == first
    second = [spark_bag(mart) for mart in build_marts(spark, *paths)]
    assert second != first and [spark_bag(mart) for mart in open_marts(spark, paths[2])] == second


def test_thresholds_of_the_job(spark, tmp_path):
    some = deliveries(spark, ball(20, bowler="A", batsman="C"), ball(40, bowler="B", batsman="D"))
    bowling, batting = build_marts(
        spark, *jobs(spark, tmp_path, some, matches(spark)), max_excluded_overs=5, max_excluded_balls=10
    )
    assert {r["bowler"] for r in dicts(bowling)} == {"B"} and {r["batsman"] for r in dicts(batting)} >= {"C", "D"}


@pytest.mark.parametrize("ids", [[1, 2, 1], [1, None]])
def test_repeated_and_missing_matches_fail_the_build(spark, tmp_path, ids):
    games = spark.createDataFrame([(i, 2008) for i in ids], MATCHES)
    paths = jobs(spark, tmp_path, deliveries(spark, ball(160)), games)
    with pytest.raises(Exception, match="matches.id is missing or repeated: (1|null)"):
        build_marts(spark, *paths)
    assert not os.path.exists(tmp_path / "marts" / "published")


def test_values_that_cannot_be_read_are_counted_and_listed(spark, tmp_path):
    lines = ["1,2008", "x,2009", "3,20o9", "y,z", "NA,", "6,2008,extra", "7", " ,2010", "8.5,2011"]
    path = write(tmp_path / "m.csv", "id,season\n" + "\n".join(lines) + "\n")
    df = read_matches(spark, path, rejects="rejects")
    found = [(r["column"], r["text"], r["row"]["id"], r["row"]["season"]) for r in rejected(df).collect()]
    assert sorted(found, key=str) == sorted(
        [("id", "x", None, 2009), ("season", "20o9", 3, None), ("id", "y", None, None), ("season", "z", None, None),
         (None, "6,2008,extra", 6, 2008), (None, "7", 7, None), ("id", "8.5", None, 2011)], key=str,
    )
    assert df.agg(reject_count()).first()[0] == 7 and df.count() == 9
    assert spark_bag(df.drop("rejects")) == spark_bag(read_matches(spark, path))


def test_too_many_rejects_fail_the_build(spark, tmp_path):
    balls, games, marts = jobs(spark, tmp_path, deliveries(spark, ball(160)), matches(spark))
    with open(os.path.join(games, "more.csv"), "w") as more:
        more.write("id,season\n77,none\n78,20x8\n")
    with pytest.raises(ValueError, match="2 values of the matches"):
        build_marts(spark, balls, games, marts, max_rejects=1)
    assert len(build_marts(spark, balls, games, marts, max_rejects=2)) == 2


def test_the_page_after_a_row_is_the_next_page(spark):
    nan, inf = float("nan"), float("inf")
    values = [inf, inf, 9.5, 9.5, 9.5, 3.0, 0.0, -inf, nan, nan, None, None, nan]
    rows = [(f"P{i * 7 % 13:02}" if i != 3 else None, v, i) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "bowler string, economy double, wickets long")
    discipline = replace(BOWLING, presets={"economy": ("economy",), "wickets": ("wickets",)})
    for metric in ("economy", "wickets"):
        ranked = metric_table(table, discipline, metric)
        for size in (1, 2, 3, 5):
            last = page(ranked, 1, size).collect()
            number = 1
            while last:
                number += 1
                after = page_after(table, discipline, metric, last[-1][metric], last[-1]["bowler"], size)
                assert "TakeOrderedAndProject" in after._jdf.queryExecution().executedPlan().toString()
                now = after.collect()
                assert str(now) == str(page(ranked, number, size).collect())
                last = now
            assert number == -(-13 // size) + 1
