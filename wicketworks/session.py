"""Session settings for tests, the bench and cluster jobs."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

TARGET_PARTITION_BYTES = 192 * 1024 * 1024


def shuffle_partitions(shuffled_bytes: int, cores: int, target: int = TARGET_PARTITION_BYTES) -> int:
    """Shuffle partitions for a job that moves ``shuffled_bytes`` in its widest exchange.

    Adaptive execution only merges partitions, so the number it starts from has to suit the
    largest exchange. Never fewer than two waves over the cores.
    """
    return max(2 * cores, math.ceil(shuffled_bytes / target))


def local_session(cores: int | str = 8, app: str = "wicketworks", **conf: str) -> SparkSession:
    """A single-JVM session. Jobs on a cluster bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
