"""Column selection and value cleaning of whole tables; each result is one ``select``."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions import text
from panelwright.functions.levels import LEVEL_CUTS, proficiency_level
from panelwright.functions.names import KEPT_SCORES, column, slice_names, unwanted_names
from panelwright.operators.frequencies import WIDE_LIMIT, long_text
from panelwright.operators.moments import numeric_columns, text_columns


def map_columns(df: DataFrame, names: Iterable[str], change: Callable[[Column], Column]) -> DataFrame:
    """Apply one expression to the named columns in a single projection."""
    chosen = set(names)
    return df.select(*[change(column(c)).alias(c) if c in chosen else column(c) for c in df.columns])


def nan_as_null(df: DataFrame) -> DataFrame:
    """One missing marker only: NaN becomes NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return map_columns(df, floats, text.nan_to_null)


def na_tokens_as_null(df: DataFrame, tokens: Sequence[str] = text.NA_TOKENS) -> DataFrame:
    return map_columns(df, text_columns(df), lambda c: text.tokens_to_null(c, tokens))


def clean_values(df: DataFrame) -> DataFrame:
    return map_columns(df, text_columns(df), text.clean_value)


def missing_labels_as_null(
    df: DataFrame, columns: Sequence[str] | None = None, tokens: Sequence[str] = text.MISSING_LABELS
) -> DataFrame:
    names = text_columns(df) if columns is None else columns
    return map_columns(df, names, lambda c: text.tokens_to_null(c, tokens))


def sentinels_as_null(
    df: DataFrame, protected: Sequence[str] = (), limit: float = text.SENTINEL_LIMIT
) -> DataFrame:
    """Error codes above the limit become NULL in the number columns, ids excepted."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return map_columns(df, [n for n in numbers if n not in protected], lambda c: text.sentinel_to_null(c, limit))


def newlines_escaped(df: DataFrame) -> DataFrame:
    return map_columns(df, text_columns(df), text.escape_newlines)


def not_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(col, mixed, whole)``: does the text column hold any value that is not a number, are all integers?

    A long aggregate; the shuffle carries one row per column and task.
    """
    pairs = long_text(df, columns)
    return pairs.groupBy("col").agg(
        F.coalesce(F.bool_or(text.is_bad_number(F.col("value"))), F.lit(False)).alias("mixed"),
        F.coalesce(F.bool_and(text.is_whole_number(F.col("value"))), F.lit(False)).alias("whole"),
    )


def numbers_or_categories(df: DataFrame, protected: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Cast every text column whose values are all numbers: to bigint if all are integers, else to double.

    Returns the table and the columns that stayed text. One planning scan decides for
    all columns; number columns are cast without looking at them, integers to bigint.
    A protected column never becomes a double, so that long ids keep all their digits.
    """
    texts = text_columns(df)
    kinds: dict[str, tuple[bool, bool]] = {}
    if 0 < len(texts) <= WIDE_LIMIT:
        flags = [f for k, n in enumerate(texts) for f in (
            F.bool_or(text.is_bad_number(column(n))).alias(f"b{k}"), F.bool_and(text.is_whole_number(column(n))).alias(f"w{k}"))]
        row = df.agg(*flags).first()
        kinds = {n: (bool(row[2 * k]), bool(row[2 * k + 1])) for k, n in enumerate(texts)}
    elif texts:
        kinds = {r["col"]: (r["mixed"], r["whole"]) for r in not_numeric(df, texts).collect()}
    mixed = [n for n in texts if kinds.get(n, (False, False))[0]]
    whole = {n for n in texts if kinds.get(n, (False, False))[1]}
    parsed = set(texts) - set(mixed)
    numbers = set(numeric_columns(df))
    integers = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}

    def typed(name: str) -> Column:
        if name in whole:
            return column(name).try_cast("bigint").alias(name)
        if name in integers:
            return column(name).cast("bigint").alias(name)
        if name in protected:
            return column(name)
        if name in parsed:
            return text.parse_number(column(name)).alias(name)
        if name in numbers:
            return column(name).cast("double").alias(name)
        return column(name)

    return df.select(*[typed(n) for n in df.columns]), mixed


def drop_unwanted(
    df: DataFrame,
    user_drops: Sequence[str] = (),
    keep: Sequence[str] = KEPT_SCORES,
    score: str | None = None,
) -> tuple[DataFrame, list[str]]:
    """Drop user columns, final weights and other scores; also tell which user columns are unknown."""
    unknown = [n for n in user_drops if n not in df.columns]
    return df.drop(*unwanted_names(df.columns, user_drops, keep, score)), unknown


def drop_marked(df: DataFrame, marks: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in marks if c in df.columns])


def split_columns(
    df: DataFrame, ranges: Sequence[tuple[int, int]], ids: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Columns inside the slice ranges and the rest, each led by the id columns."""
    ids = [n for n in ids if n in df.columns]
    inside = slice_names(df.columns, ranges)
    outside = [n for n in df.columns if n not in inside]
    first, second = (list(dict.fromkeys([*ids, *part])) for part in (inside, outside))
    return df.select(*[column(n) for n in first]), df.select(*[column(n) for n in second])


def add_level(
    df: DataFrame, score: str, cuts: Sequence[tuple[float, str]] = LEVEL_CUTS
) -> DataFrame:
    """Add ``<score>_level`` when the table has the score."""
    if score not in df.columns:
        return df
    return df.withColumn(f"{score}_level", proficiency_level(column(score), cuts))


def select_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in wanted order, each once."""
    names = [n for n in dict.fromkeys(wanted) if n in df.columns]
    return df.select(*[column(n) for n in names])


def select_required(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns; an unknown one is an error."""
    unknown = [n for n in wanted if n not in df.columns]
    if unknown:
        raise ValueError(f"columns not found: {unknown}")
    return select_existing(df, wanted)
