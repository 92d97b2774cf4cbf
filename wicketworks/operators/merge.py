"""Putting tables together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketworks.functions import natural_full_join


def merge_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Full outer join of all tables on the columns they share.

    Where all share the same columns and no others, as measures of one kind of key do, the tables are stacked, each with its own
    columns in a struct of their own, and grouped once: one exchange of rows that each table has added up already,
    instead of one for each join. A key without a row in a table has no struct, so its columns are null, like
    those of a row that holds nulls. Missing keys are keys like others. A key that a table has twice is an error there, as it would
    multiply the rows of the others. Tables that share columns in another way are joined one after the other.
    """
    keys = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
    own = [[c for c in t.columns if c not in keys] for t in tables]
    names = [c for columns in own for c in columns]
    if len(tables) < 2 or not keys or len(set(names)) < len(names):
        return reduce(natural_full_join, tables)
    tagged = [
        t.select(*keys, F.struct(F.lit(True).alias("is_row"), *columns).alias(f"table{i}"))
        for i, (t, columns) in enumerate(zip(tables, own))
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    merged = stacked.groupBy(*keys).agg(*(_only(f"table{i}") for i in range(len(tables))))
    return merged.select(*keys, *(F.col(f"table{i}")[c].alias(c) for i, columns in enumerate(own) for c in columns))


def _only(table: str) -> Column:
    """The one row of a table that a key has."""
    twice = F.raise_error(F.lit(f"a key occurs twice in the merged tables ({table})"))
    return F.when(F.count(table) > 1, twice).otherwise(F.first(table, ignorenulls=True)).alias(table)


def distinct_union(*tables: DataFrame) -> DataFrame:
    """Rows of all tables by column name, without repeats."""
    return reduce(DataFrame.unionByName, tables).distinct()
