"""Facts with their match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicketworks.functions import counts_small

#: What an id takes in a broadcast table.
ID_BYTES = 32


def combine(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    """Every ball with the columns of its match; the key keeps the name ``match_id``.

    No broadcast hint: matches grow with the balls, so Spark picks the join by measured size.
    """
    return deliveries.join(matches.withColumnRenamed("id", "match_id"), "match_id")


def checked_matches(matches: DataFrame) -> DataFrame:
    """Matches as they are, in one grouping that fails on an id that is missing or occurs twice.

    Each ball of a repeated match would count twice in sums and once in maidens, and that of a missing one not at all.
    """
    others = [c for c in matches.columns if c != "id"]
    wrong = F.raise_error(F.concat(F.lit("matches.id is missing or repeated: "), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    row = F.when((F.count(F.lit(1)) > 1) | F.col("id").isNull(), wrong).otherwise(F.first(F.struct(*others)))
    return matches.groupBy("id").agg(row.alias("row")).select("id", "row.*")


def of_season(deliveries: DataFrame, matches: DataFrame, season: int) -> tuple[DataFrame, DataFrame]:
    """The balls of one season, if that can be told before they are added up, and its matches.

    The filter on the season reaches the scan of the matches, and a semi-join with their ids drops the other
    balls before anything is grouped. Ids above Spark's broadcast limit would make it move all balls instead; the balls then stay as
    they are, and the matches, joined after the first grouping, drop what is left.
    """
    games = matches.where(F.col("season") == season)
    ids = games.select(F.col("id").alias("match_id"))
    if not counts_small(ids, ID_BYTES):
        return deliveries, games
    return deliveries.join(F.broadcast(ids), "match_id", "left_semi"), games


def attach_season(totals: DataFrame, matches: DataFrame) -> DataFrame:
    """Season for rows already added up within a match."""
    seasons = matches.select(F.col("id").alias("match_id"), "season")
    return totals.join(seasons, "match_id")
