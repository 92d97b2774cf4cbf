"""Ranking order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def best_first(metric: str, player: str) -> list[Column]:
    """Largest metric first: infinity leads, NaN and null come last, ties go by player name."""
    value = F.col(metric)
    return [F.when(~F.isnan(value), value).desc_nulls_last(), F.asc(player)]
