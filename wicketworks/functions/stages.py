"""Phases of an innings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketworks.schema import STAGES


def in_stage(stage: str, over: str = "over") -> Column:
    """Overs of one stage. The first stage has no lower bound and the last no upper bound."""
    first, last = STAGES[stage]
    if stage == next(iter(STAGES)):
        return F.col(over) <= last
    if last is None:
        return F.col(over) >= first
    return F.col(over).between(first, last)


def stage_of(over: str = "over") -> Column:
    """Stage of an over; a missing over has none."""
    tag = F.lit(None).cast("string")
    for stage in STAGES:
        tag = F.when(in_stage(stage, over), F.lit(stage)).otherwise(tag)
    return tag


def with_stage(facts: DataFrame) -> DataFrame:
    """Facts that belong to a stage, tagged with it."""
    return facts.where(F.col("over").isNotNull()).withColumn("stage", stage_of())
