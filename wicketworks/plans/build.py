"""The job that turns the two input tables into written marts.

A build writes to a folder of its own below ``builds`` and is published last, by one row appended to ``published``. Readers
open the latest published build: a build that fails half-way is never seen, and both marts of a reader are of one build.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wicketworks.operators.combine import checked_matches
from wicketworks.operators.lattice import LATTICE_KEYS, lattice, lattice_schema
from wicketworks.plans.marts import batting_totals_of, bowling_totals_of, excluded_of, finished_batting, finished_bowling
from wicketworks.plans.rollup import grain, match_rollup, write_rollup
from wicketworks.schema import (
    BATTING,
    BATTING_MART,
    BOWLING,
    BOWLING_MART,
    CREDITED_DISMISSALS,
    MATCHES,
    MAX_EXCLUDED_BALLS_FACED,
    MAX_EXCLUDED_OVERS,
)
from wicketworks.sources import read_deliveries, read_mart, read_matches, reject_count, write_mart

EXCLUDED = "batsman string, season int"
PUBLISHED = "built_at double, build string"


def build_marts(
    spark: SparkSession,
    deliveries: str | list[str],
    matches: str | list[str],
    folder: str,
    *,
    kinds: Sequence[str] = CREDITED_DISMISSALS,
    max_excluded_overs: float = MAX_EXCLUDED_OVERS,
    max_excluded_balls: int = MAX_EXCLUDED_BALLS_FACED,
    max_rejects: int | None = None,
    format: str = "csv",
) -> tuple[DataFrame, DataFrame]:
    """Read balls and matches, write both marts and their lattices below ``folder``, publish them, return the marts as stored.

    ``format`` is that of both inputs, ``csv`` or ``parquet``. Each input is read once: the matches are checked while
    they are stored, and the balls become a rollup of overs and partnerships (``match_rollup``) that all else
    derives from. The list of excluded batsmen is stored before it is joined, so that its size is known.
    A repeated or missing match id fails the build, since its balls would count twice; so do more than
    ``max_rejects`` values of CSV files that could not be read, which are counted in the same pass.
    """
    build = f"{time.strftime('%Y%m%dT%H%M%S')}-{uuid.uuid4().hex[:8]}"
    at = f"{folder}/builds/{build}"
    rejects = {"deliveries": Observation(), "matches": Observation()} if format == "csv" else {}

    def counted(name: str, df: DataFrame) -> DataFrame:
        return df.observe(rejects[name], reject_count().alias("rejects")).drop("rejects") if rejects else df

    options = {"rejects": "rejects"} if rejects else {}
    games = counted("matches", read_matches(spark, matches, format, **options))
    checked_matches(games).write.parquet(f"{at}/matches")
    games = spark.read.schema(MATCHES).parquet(f"{at}/matches")
    write_rollup(match_rollup(counted("deliveries", read_deliveries(spark, deliveries, format, **options)), kinds), f"{at}/rollup")
    for name, seen in rejects.items():
        if max_rejects is not None and (n := seen.get["rejects"] or 0) > max_rejects:
            raise ValueError(f"{n} values of the {name} could not be read; at most {max_rejects} may")
    rollup = spark.read.parquet(f"{at}/rollup")
    overs, partnerships = grain(rollup, "over"), grain(rollup, "partnership")
    excluded_of(partnerships, games, max_excluded_balls).write.parquet(f"{at}/excluded_batsmen")
    excluded = spark.read.schema(EXCLUDED).parquet(f"{at}/excluded_batsmen")
    marts = {
        "bowling": (finished_bowling(bowling_totals_of(overs, games, max_excluded_overs)), BOWLING_MART, BOWLING),
        "batting": (finished_batting(batting_totals_of(partnerships, games, excluded, max_excluded_balls)), BATTING_MART, BATTING),
    }
    for name, (mart, schema, discipline) in marts.items():
        write_mart(mart, f"{at}/{name}")
        stored = read_mart(spark, f"{at}/{name}", schema)
        write_mart(lattice(stored, discipline), f"{at}/{name}_lattice", order=LATTICE_KEYS[1:])
    # Spark makes an append visible as a whole, or not at all.
    spark.createDataFrame([(time.time(), build)], PUBLISHED).coalesce(1).write.mode("append").parquet(f"{folder}/published")
    return open_marts(spark, folder)


def latest_build(spark: SparkSession, folder: str) -> str:
    """The folder of the build that was published last."""
    published = spark.read.schema(PUBLISHED).parquet(f"{folder}/published")
    return f"{folder}/builds/{published.agg(F.max_by('build', F.struct('built_at', 'build'))).first()[0]}"


def open_marts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The bowling and the batting mart of the latest build."""
    at = latest_build(spark, folder)
    return (
        read_mart(spark, f"{at}/bowling", BOWLING_MART),
        read_mart(spark, f"{at}/batting", BATTING_MART),
    )


def open_lattices(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The roll-ups of both marts over innings and stages, of the latest build; see ``operators.lattice``."""
    at = latest_build(spark, folder)
    return (
        read_mart(spark, f"{at}/bowling_lattice", lattice_schema(BOWLING_MART, BOWLING)),
        read_mart(spark, f"{at}/batting_lattice", lattice_schema(BATTING_MART, BATTING)),
    )
