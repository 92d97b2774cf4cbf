"""Column expressions with the number, missing-value and ordering rules of the statistics."""

from wicketworks.functions.keys import natural_full_join, null_safe_join, paste_key
from wicketworks.functions.numeric import (
    clear_infinite,
    clear_nan,
    fill_missing,
    guarded_ratio,
    ieee_ratio,
    round_numeric,
    round_one,
    rows,
    strict_sum,
    tenths_sum,
)
from wicketworks.functions.ordering import best_first
from wicketworks.functions.sizes import broadcast_limit, counts_small, is_small
from wicketworks.functions.stages import in_stage, stage_of, with_stage

__all__ = [
    "best_first",
    "broadcast_limit",
    "clear_infinite",
    "clear_nan",
    "counts_small",
    "fill_missing",
    "guarded_ratio",
    "ieee_ratio",
    "in_stage",
    "is_small",
    "natural_full_join",
    "null_safe_join",
    "paste_key",
    "round_numeric",
    "round_one",
    "rows",
    "stage_of",
    "strict_sum",
    "tenths_sum",
    "with_stage",
]
