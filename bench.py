"""Times the headline queries and prints one JSON line.

The marts are computed from balls and matches; the requests read the written marts, as a user's
requests would. Each query runs once to warm up, then three times; its median counts, with the time
to put the query together.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wicketworks.checks import views  # noqa: E402
from wicketworks.checks.queries import registered  # noqa: E402
from wicketworks.plans import (  # noqa: E402
    batting_mart,
    bowling_mart,
    build_marts,
    compare_seasons,
    leaderboard,
    open_lattices,
    top_players,
)
from wicketworks.schema import BATTING, BATTING_MART, BOWLING, BOWLING_MART  # noqa: E402
from wicketworks.session import local_session  # noqa: E402
from wicketworks.sources import read_mart, write_mart  # noqa: E402

REPEATS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    balls, matches = views.deliveries(spark, sf_dir), views.matches(spark, sf_dir)
    folder = tempfile.mkdtemp(prefix="bench-marts-")

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def bowling():
        return read_mart(spark, f"{folder}/bowling", BOWLING_MART)

    def batting():
        return read_mart(spark, f"{folder}/batting", BATTING_MART)

    named = registered()
    balls.write.parquet(f"{folder}/balls")
    matches.write.parquet(f"{folder}/matches")
    queries = {
        "bowling_mart": lambda: run(bowling_mart(balls, matches)),
        "batting_mart": lambda: run(batting_mart(balls, matches)),
        "write_bowling_mart": lambda: write_mart(bowling_mart(balls, matches), f"{folder}/bowling"),
        "write_batting_mart": lambda: write_mart(batting_mart(balls, matches), f"{folder}/batting"),
        "leaderboard_bowling": lambda: run(leaderboard(bowling(), BOWLING)),
        "leaderboard_batting": lambda: run(leaderboard(batting(), BATTING)),
        "top6_bowling": lambda: run(top_players(bowling(), BOWLING, metric="economy")),
        "top6_batting": lambda: run(top_players(batting(), BATTING, metric="strike_rate")),
        "compare_bowlers": lambda: run(compare_seasons(bowling(), "Bowler 5", "Bowler 21")),
        "seasons": lambda: run(named["seasons"](spark, sf_dir)),
        "bowler_qualified": lambda: run(named["bowler_qualified"](spark, sf_dir)),
        "batsman_qualified": lambda: run(named["batsman_qualified"](spark, sf_dir)),
        "top6_from_balls": lambda: run(named["top6_bowling_wickets"](spark, sf_dir)),
        "bowling_merge_all": lambda: run(named["bowling_merge_all"](spark, sf_dir)),
        "batting_merge_all": lambda: run(named["batting_merge_all"](spark, sf_dir)),
        "bowling_stage_union": lambda: run(named["bowling_stage_union"](spark, sf_dir)),
        "batting_stage_union": lambda: run(named["batting_stage_union"](spark, sf_dir)),
        "build": lambda: build_marts(spark, f"{folder}/balls", f"{folder}/matches", f"{folder}/job", format="parquet"),
        "lattice_bowling": lambda: run(leaderboard(open_lattices(spark, f"{folder}/job")[0], BOWLING)),
        "lattice_batting": lambda: run(leaderboard(open_lattices(spark, f"{folder}/job")[1], BATTING)),
    }
    seconds = {}
    for name, query in queries.items():
        query()
        times = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            query()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    report = {
        "metric": "total of median query times",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rsplit("sf", 1)[-1],
        "cores": cores,
        "spark": spark.version,
    }
    spark.stop()
    print(json.dumps(report))


if __name__ == "__main__":
    main()
