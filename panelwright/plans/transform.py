"""Join survey tables around the score table, reduce their columns, add the level."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from panelwright.functions.levels import LEVEL_CUTS
from panelwright.operators.columns import add_level, drop_unwanted, split_columns
from panelwright.operators.joins import star_join


def split_tables(
    tables: Mapping[str, DataFrame], ranges: Sequence[tuple[int, int]], ids: Sequence[str] = ()
) -> dict[str, DataFrame]:
    parts = {}
    for name, df in tables.items():
        parts[f"{name}_part1"], parts[f"{name}_part2"] = split_columns(df, ranges, ids)
    return parts


def transform(
    tables: Mapping[str, DataFrame],
    score: str,
    ids: Sequence[str] | None = None,
    split_ranges: Sequence[tuple[int, int]] | None = None,
    cuts: Sequence[tuple[float, str]] = LEVEL_CUTS,
    null_safe: bool = False,
) -> dict[str, DataFrame]:
    """Joined, reduced and leveled tables by name; lazy, one plan per table."""
    if not score:
        raise ValueError("a score column is required")
    if split_ranges:
        tables = split_tables(tables, split_ranges, ids or ())
    joined = star_join(tables, score, ids, null_safe)
    reduced = {name: drop_unwanted(df, score=score)[0] for name, df in joined.items()}
    return {name: add_level(df, score, cuts) for name, df in reduced.items()}


def level_table(df: DataFrame, score: str, cuts: Sequence[tuple[float, str]] = LEVEL_CUTS) -> DataFrame:
    """The same reduction and level for a single table without joins."""
    return add_level(drop_unwanted(df, score=score)[0], score, cuts)
