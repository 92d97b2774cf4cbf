"""The marts as parquet, partitioned by season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_mart(mart: DataFrame, path: str, mode: str = "overwrite", order: Sequence[str] = ()) -> None:
    """Write a mart partitioned by season, the column every ranking request filters on.

    The rebalance hint gives each season few files, and lets adaptive execution split a season
    that is too large for one task. Rows are sorted by ``order`` and player, so that a comparison of two players
    skips the row groups without them.
    """
    player = mart.columns[0]
    rows = mart.hint("rebalance", "season").sortWithinPartitions("season", *order, player)
    rows.write.mode(mode).partitionBy("season").parquet(path)


def read_mart(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a written mart with its declared types and column order."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)
