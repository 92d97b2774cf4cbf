"""Player-season keys and joins in which a missing key matches a missing key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RIGHT = "_right_"


def paste_key(*columns: str) -> Column:
    """The columns written one after the other, a null as ``NA``.

    A label only: without a separator two pairs may give the same text, so joins use the columns.
    """
    return F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join on ``on`` with null equal to null. Keys of an inner or outer result are merged.

    The right-hand keys are renamed first, so that both sides may come from one table.
    """
    renamed = right.withColumnsRenamed({c: _RIGHT + c for c in on})
    condition = reduce(and_, (F.col(c).eqNullSafe(F.col(_RIGHT + c)) for c in on))
    joined = left.join(renamed, condition, how)
    if how in ("left_anti", "left_semi"):
        return joined
    if how in ("right", "full"):
        joined = joined.withColumns({c: F.coalesce(F.col(c), F.col(_RIGHT + c)) for c in on})
    return joined.drop(*(_RIGHT + c for c in on))


def natural_full_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join on the columns the tables share."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the tables share no column to join on")
    return null_safe_join(left, right, shared, "full")
