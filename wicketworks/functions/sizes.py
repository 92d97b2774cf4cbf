"""Sizes that decide how tables are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which Spark broadcasts a table; negative if it never does."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def planned_bytes(df: DataFrame) -> int:
    """What Spark expects ``df`` to take: the size of the files for a stored table, and an upper bound for most others."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame) -> bool:
    """Whether Spark would broadcast ``df`` as it is planned."""
    return 0 <= planned_bytes(df) <= broadcast_limit(df.sparkSession)


def counts_small(df: DataFrame, row_bytes: int) -> bool:
    """Whether ``df`` is small as planned or, where that is not known, as counted. Only the second takes a job."""
    limit = broadcast_limit(df.sparkSession)
    return limit > 0 and (is_small(df) or df.limit(limit // row_bytes + 1).count() * row_bytes <= limit)
