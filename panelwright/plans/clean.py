"""Cleaning of one table: names, values, types, then redundant, uniform and sparse columns."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from panelwright.functions.names import clean_header, clean_headers
from panelwright.operators.columns import (
    clean_values,
    missing_labels_as_null,
    nan_as_null,
    numbers_or_categories,
    sentinels_as_null,
)
from panelwright.operators.frequencies import sparse_columns, uniform_columns
from panelwright.operators.moments import redundant_columns
from panelwright.session import written_once


class Cleaned(NamedTuple):
    table: DataFrame
    correlated: list[str]
    uniform: list[str]
    sparse: list[str]


def clean_cells(df: DataFrame) -> DataFrame:
    """The row-wise steps in their fixed order; Catalyst folds them into one projection.

    Escaping of line breaks would come last, but cleaned values hold none any more.
    Error codes go after the types are known, see :func:`typed_cells`.
    """
    return missing_labels_as_null(clean_values(clean_headers(nan_as_null(df))))


def typed_cells(df: DataFrame, protected: Sequence[str] = ()) -> DataFrame:
    """Cleaned cells with their types; then error codes go in every number column, also in those read as text."""
    typed, _ = numbers_or_categories(clean_cells(df), protected)
    return sentinels_as_null(typed, protected)


def clean(
    df: DataFrame,
    protected: Sequence[str] = (),
    missing_threshold: float = 1.0,
    uniform_threshold: float = 1.0,
    correlation_threshold: float = 1.0,
    target: str | None = None,
    strict_reference: bool = False,
    materialise: bool = True,
) -> Cleaned:
    """Clean a table and drop the columns the thresholds rule out.

    Ids and target are protected from every rule; ``strict_reference`` protects ids
    only from the sentinel rule. Each rule is one planning job that returns facts
    per column, never rows. With ``materialise`` the typed cells are written to the
    shared folder first, so the input is read twice (types, cells) and the planning
    scans read typed columns instead of cleaning the text again each time.
    """
    protected = [clean_header(p) for p in protected if p]
    target = clean_header(target) if target else None
    df = typed_cells(df, protected)
    if materialise:
        df = written_once(df, "cells")
    safe = [] if strict_reference else [*protected, *([target] if target else [])]
    correlated = redundant_columns(df, correlation_threshold, target, safe, strict_reference)
    df = df.drop(*correlated)
    uniform = uniform_columns(df, uniform_threshold, safe)
    df = df.drop(*uniform)
    sparse = sparse_columns(df, missing_threshold, safe)
    return Cleaned(df.drop(*sparse), correlated, uniform, sparse)
