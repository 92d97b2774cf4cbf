"""The first grouping of both marts in one scan, to be stored.

Bowling starts from overs and batting from partnerships. Both are grouping sets of the same balls, so one scan
and one exchange give both, already added up in the map tasks. Stored, they are what the list of excluded batsmen and
both marts derive from, and the balls need not be read or parsed again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicketworks.functions import rows, stage_of, strict_sum
from wicketworks.operators.bowling import is_credited
from wicketworks.schema import CREDITED_DISMISSALS

OVER = ("match_id", "inning", "over", "bowler")
PARTNERSHIP = ("match_id", "inning", "stage", "batsman", "non_striker", "player_dismissed")
OVER_MEASURES = ("balls", "dotballs", "runsgiven", "bat_runs", "extra_runs", "wickets")
PARTNERSHIP_MEASURES = ("balls", "runs", "unknown", "fours", "sixes")
GRAINS = {"over": (OVER, OVER_MEASURES), "partnership": (PARTNERSHIP, PARTNERSHIP_MEASURES)}


def match_rollup(deliveries: DataFrame, kinds: Sequence[str] = CREDITED_DISMISSALS) -> DataFrame:
    """Overs and partnerships in one table, told apart by ``grain``; columns of the other grain are null."""
    columns = list(dict.fromkeys([*OVER, *PARTNERSHIP]))
    balls = deliveries.withColumn("stage", stage_of())
    runs = F.col("batsman_runs")
    return (
        balls.groupingSets([[F.col(c) for c in OVER], [F.col(c) for c in PARTNERSHIP]], *(F.col(c) for c in columns))
        .agg(
            F.when(F.grouping("bowler") == 0, "over").otherwise("partnership").alias("grain"),
            rows().alias("balls"),
            F.count_if(F.col("total_runs") == 0).alias("dotballs"),
            strict_sum("total_runs").alias("runsgiven"),
            strict_sum("batsman_runs").alias("bat_runs"),
            strict_sum("extra_runs").alias("extra_runs"),
            F.count_if(is_credited(kinds)).alias("wickets"),
            F.coalesce(F.sum("batsman_runs"), F.lit(0)).alias("runs"),
            F.count_if(runs.isNull()).alias("unknown"),
            F.count_if(runs == 4).alias("fours"),
            F.count_if(runs == 6).alias("sixes"),
        )
    )


def write_rollup(rollup: DataFrame, path: str) -> None:
    """One folder for each grain, so that reading one does not read the other."""
    rollup.write.mode("overwrite").partitionBy("grain").parquet(path)


def grain(rollup: DataFrame, name: str) -> DataFrame:
    """The rows and columns of one grain."""
    keys, measures = GRAINS[name]
    return rollup.where(F.col("grain") == name).select(*keys, *measures)
