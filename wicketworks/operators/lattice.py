"""All roll-ups of a mart over innings and stages, computed once and stored, so that a request is a filter.

A request names a season, an inning or all, and a stage or all. These are the grouping sets of (inning, stage); each is kept
with what was asked for in ``inning_choice`` and ``stage_choice``. Stages are rolled up from the rounded roll-ups of the innings,
as a request that starts from the mart does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wicketworks.functions import round_numeric
from wicketworks.operators.rollup import roll_up
from wicketworks.schema import DEFAULT_INNING, DEFAULT_STAGE, INNING_CHOICES, STAGE_CHOICES, Discipline

#: What a request names. A stored lattice is partitioned by the first and sorted by the others.
LATTICE_KEYS = ("season", "inning_choice", "stage_choice")
_LABELS = {name: choice for choice, name in STAGE_CHOICES.items() if name}


def lattice(mart: DataFrame, discipline: Discipline) -> DataFrame:
    """Each player's measures for every season, inning choice and stage choice.

    The mart is read once: each row goes to the choices that it counts for, first those of innings, then those of
    stages, and is grouped there. What a choice shows of one row of the mart is that row, with its own ratios; what it adds up
    gets them anew. Innings other than 1 and 2 count in the roll-up of all innings, as they have no choice of their own.
    ``stage`` stays, null where stages are rolled up; measures of one inning only are null there, too.
    """
    player, ratios = discipline.player, [r.name for r in discipline.ratios]
    innings = [str(number) for number in INNING_CHOICES.values() if number is not None]
    own_inning = F.col("inning").cast("string")
    by_inning = _grouped(mart, discipline, [player, "season", "stage"], "inning_choice", F.when(own_inning.isin(*innings), own_inning), DEFAULT_INNING)
    label = reduce(lambda rest, s: F.when(F.col("stage") == s, _LABELS[s]).otherwise(rest), _LABELS, F.lit(None).cast("string"))
    whole = F.col("stage_choice") == DEFAULT_STAGE
    found = _grouped(by_inning, discipline, [player, "season", "inning_choice"], "stage_choice", label, DEFAULT_STAGE)
    stage = reduce(lambda rest, s: F.when(F.col("stage_choice") == _LABELS[s], s).otherwise(rest), _LABELS, F.lit(None).cast("string"))
    found = found.withColumns({m: F.when(~whole, F.col(m)) for m in discipline.inning_only}).withColumn("stage", stage)
    return found.select(player, *LATTICE_KEYS, "stage", *discipline.measures, *ratios)


def lattice_schema(mart: T.StructType, discipline: Discipline) -> T.StructType:
    """Columns and types of the lattice of a mart with these columns."""
    names = [discipline.player, *LATTICE_KEYS, "stage", *discipline.measures, *(r.name for r in discipline.ratios)]
    known = {field.name: field.dataType for field in mart.fields}
    return T.StructType([T.StructField(name, known.get(name, T.StringType())) for name in names])


def _grouped(table: DataFrame, discipline: Discipline, keys: list[str], name: str, own: Column, every: str) -> DataFrame:
    """Rows as they are under their own choice, if they have one, and added up under the choice ``every``."""
    ratios = [r.name for r in discipline.ratios]
    spread = table.withColumn(name, F.explode(F.array_compact(F.array(own, F.lit(every)))))
    as_is = [F.first(r).alias(f"own_{r}") for r in ratios]
    rolled = round_numeric(roll_up(spread, discipline, [*keys, name], (), *as_is))
    kept = {r: F.when(F.col(name) == every, F.col(r)).otherwise(F.col(f"own_{r}")) for r in ratios}
    return rolled.withColumns(kept).drop(*(f"own_{r}" for r in ratios))


def from_lattice(
    stored: DataFrame, discipline: Discipline, season: int | str, inning: str | int = DEFAULT_INNING, stage: str = DEFAULT_STAGE
) -> DataFrame:
    """The rows of a request. On a stored lattice this reads those rows of one folder, and nothing is grouped."""
    inning = str(inning) if INNING_CHOICES.get(str(inning)) is not None else DEFAULT_INNING
    stage = stage if STAGE_CHOICES.get(stage) else _LABELS.get(stage, DEFAULT_STAGE)
    chosen = stored.where(
        (F.col("season") == int(season)) & (F.col("inning_choice") == inning) & (F.col("stage_choice") == stage)
    )
    dropped = ["stage", *discipline.inning_only] if stage == DEFAULT_STAGE else []
    return chosen.drop("season", "inning_choice", "stage_choice", *dropped)
