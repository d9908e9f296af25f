"""Which columns hold the score, the school and the student."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.names import (
    SCHOOL_WORDS,
    SCORE_WORDS,
    STUDENT_WORDS,
    column,
    leveled_score_name,
    role_candidates,
)


# Relative standard error of the cardinality sketches, and how many of them the true count may lie off; beyond five
# lies less than one count in a million.
SKETCH_ERROR, SKETCH_WIDTH = 0.01, 5


class Roles(NamedTuple):
    score: str | None = None
    school: str | None = None
    student: str | None = None
    leveled_score: str | None = None


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Exact distinct counts of a few columns in one job.

    Values are counted in long form, so they are pre-aggregated before the shuffle
    and no column multiplies the rows of another.
    """
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    pairs = df.select(*[column(n).cast("string").alias(n) for n in columns]).unpivot(
        [], [column(n) for n in columns], "col", "value"
    )
    rows = pairs.filter(F.col("value").isNotNull()).distinct().groupBy("col").count().collect()
    found = {r["col"]: r["count"] for r in rows}
    return {n: found.get(n, 0) for n in columns}


def distinct_bounds(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Bounds of the distinct counts of a few columns, from sketches of bounded size: one scan, no value is shuffled."""
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    row = df.agg(*[F.approx_count_distinct(column(n).cast("string"), SKETCH_ERROR).alias(f"n{k}") for k, n in enumerate(columns)]).first()
    off = SKETCH_WIDTH * SKETCH_ERROR
    return {n: (estimate * (1 - off), estimate * (1 + off)) for n, estimate in zip(columns, row)}


def leaders(bounds: Sequence[tuple[float, float]]) -> list[int]:
    """Places of the counts that may be the largest."""
    most = max((low for low, _ in bounds), default=0)
    return [k for k, (_, high) in enumerate(bounds) if high >= most]


def detect_roles(df: DataFrame, given: Roles = Roles()) -> Roles:
    """Best column per role by name; ties go to the most distinct values, then to the first.

    A given name wins when the table has it. Rows are read for ties only: sketches decide a tie that is
    clear, and only columns whose bounds overlap are counted exactly.
    """
    names = df.columns
    words = {"score": SCORE_WORDS, "school": SCHOOL_WORDS, "student": STUDENT_WORDS}
    candidates = {}
    for role, keywords in words.items():
        chosen = getattr(given, role)
        candidates[role] = [chosen] if chosen in names else role_candidates(names, keywords)
    bounds = distinct_bounds(df, [n for tied in candidates.values() if len(tied) > 1 for n in tied])
    for role, tied in candidates.items():
        if len(tied) > 1:
            candidates[role] = [tied[k] for k in leaders([bounds[n] for n in tied])]
    counts = distinct_counts(df, [n for tied in candidates.values() if len(tied) > 1 for n in tied])
    picked = {r: max(tied, key=lambda n: counts.get(n, 0), default=None) for r, tied in candidates.items()}
    return Roles(**picked, leveled_score=leveled_score_name(names, picked["score"]))


def best_roles(tables: Mapping[str, DataFrame], given: Roles = Roles()) -> Roles:
    """Roles over several tables: first score found, id columns with the most distinct values.

    Id columns of several tables are set against each other by sketches first, as in :func:`detect_roles`.
    """
    score = leveled = None
    found: dict[str, list[tuple[DataFrame, str]]] = {"school": [], "student": []}
    for df in tables.values():
        roles = detect_roles(df, given)
        if score is None and roles.score is not None:
            score, leveled = roles.score, roles.leveled_score
        for role, places in found.items():
            if getattr(roles, role) is not None:
                places.append((df, getattr(roles, role)))
    best: dict[str, str | None] = {}
    for role, places in found.items():
        if len(places) > 1:
            places = [places[k] for k in leaders([distinct_bounds(df, [n])[n] for df, n in places])]
        if len(places) > 1:
            places = [max(places, key=lambda place: distinct_counts(place[0], [place[1]])[place[1]])]
        best[role] = places[0][1] if places else None
    return Roles(score, best["school"], best["student"], leveled)


def essential_columns(df: DataFrame, ids: Sequence[str] | None = None) -> list[str]:
    """Columns a reduced data set always keeps: ids and the leveled score."""
    roles = detect_roles(df)
    if ids:
        kept = [n for n in ids if n in df.columns]
    else:
        kept = [n for n in (roles.school, roles.student) if n]
        kept = kept or [n for n in df.columns if "id" in n.lower()]
    return list(dict.fromkeys([*kept, *([roles.leveled_score] if roles.leveled_score else [])]))
