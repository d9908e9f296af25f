"""One look-up for many columns: all cells meet the dictionary in a single exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.names import column
from panelwright.session import written_once

ROW, PLACE, KEY, FOUND = "__row", "__place", "__key", "__found"


def text_key(text: Column) -> Column:
    """Sixteen bytes that stand for a text, so that no text moves to meet another; NULL for a missing one."""
    return F.unhex(F.md5(text.cast("binary")))


def dictionary_rows(place: Column, text: Column, value: Column) -> list[Column]:
    """Columns of a dictionary: number of the looked-up column, key, value."""
    return [place.cast("int").alias(PLACE), text_key(text).alias(KEY), value.alias(FOUND)]


def look_up(df: DataFrame, texts: Sequence[Column], dictionary: DataFrame, drop: Sequence[str] = ()) -> tuple[DataFrame, list[Column]]:
    """The rows, and for each text a column with its value in the dictionary, NULL where it has none.

    The dictionary has one value per (column number, key). The rows are written once with a number; their cells, as
    number, column and key, meet the dictionary in one join, and the hits return to their rows in another, so the plan
    does not grow with the columns. Columns in ``drop`` are needed for the keys only. A key that many rows hold is one skewed join, which adaptive execution splits.
    """
    keys = [f"{KEY}{k}" for k in range(len(texts))]
    rows = written_once(df.select(
        *[column(c) for c in df.columns if c not in drop], *[text_key(t).alias(k) for t, k in zip(texts, keys)], F.monotonically_increasing_id().alias(ROW)), "rows")
    cells = rows.select(ROW, F.inline(F.array(*[
        F.struct(F.lit(k).alias(PLACE), F.col(key).alias(KEY)) for k, key in enumerate(keys)]))).filter(F.col(KEY).isNotNull())
    hits = cells.join(dictionary, [PLACE, KEY]).groupBy(ROW).agg(
        F.map_from_entries(F.collect_list(F.struct(PLACE, FOUND))).alias(FOUND))
    found = rows.drop(*keys).join(hits, ROW, "left").drop(ROW)
    return found, [F.try_element_at(F.col(FOUND), F.lit(k)) for k in range(len(texts))]
