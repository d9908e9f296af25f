"""Score to proficiency level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: lower bound of each level, highest first -------------------
LEVEL_CUTS = (
    (669.30, "Level 6"),
    (607.04, "Level 5"),
    (544.68, "Level 4"),
    (482.38, "Level 3"),
    (420.07, "Level 2"),
    (358.77, "Level 1"),
)
BELOW_LOWEST = "Below Level 1"
# ----------------------------------------------------------------------------


def proficiency_level(
    score: Column, cuts: Sequence[tuple[float, str]] = LEVEL_CUTS, below: str = BELOW_LOWEST
) -> Column:
    """Name of the highest level whose lower bound the score reaches; NULL stays NULL.

    Spark orders NaN above every number, so NaN is treated as missing first.
    """
    value = score.cast("double")
    level = F.when(value.isNull() | F.isnan(value), None)
    for lower, name in sorted(cuts, reverse=True):
        level = level.when(value >= lower, name)
    return level.otherwise(below)
