"""Left joins of survey tables and the choice of their keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.names import LAST_COLUMN, column, merge_key
from panelwright.operators.frequencies import frequent_values

# Share of a table's rows from which a key counts as hot: what a frequent-items sketch finds without a miss.
HOT_SHARE = 0.02
LEFT_PART, RIGHT_PART, RIGHT_KEY = "__left_part", "__right_part", "__key"


def move_last(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        return df
    return df.select(*[column(c) for c in df.columns if c != name], column(name))


class Hot(NamedTuple):
    """Hot keys of a table, whether the missing key is one, and the parts into which the rows of such a key are dealt."""

    keys: tuple = ()
    nulls: bool = False
    parts: int = 1

    def has(self, key: Column, nulls: bool = True) -> Column:
        listed = F.coalesce(key.isin(*self.keys), F.lit(False)) if self.keys else F.lit(False)
        return listed | key.isNull() if self.nulls and nulls else listed


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> Hot:
    """Keys that hold at least ``share`` of the rows, by a sketch of the key column: one scan, no shuffle of rows.

    A hot key is dealt into as many parts as make each about as large as a partition, if the hottest one
    held all rows that others leave.
    """
    found = tuple(value for _, value in frequent_values(df, [key], share))
    rows, nulls, *counts = df.agg(
        F.count(F.lit(1)), F.count_if(column(key).isNull()), *[F.count_if(column(key) == F.lit(k)) for k in found]).first()
    kept = tuple(k for k, n in zip(found, counts) if n >= share * rows)
    if not rows or not kept and nulls < share * rows:
        return Hot()
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Hot(kept, nulls >= share * rows, max(2, ceil(partitions * max([nulls, *counts]) / rows)))


def _part(df: DataFrame, parts: int) -> Column:
    """A part for each row that a task meets again when it runs again."""
    return F.pmod(F.xxhash64(*[column(c).cast("string") for c in df.columns], F.spark_partition_id()), F.lit(parts)).cast("int")


def _copies(repeated: Column, parts: int) -> Column:
    return F.explode(F.when(repeated, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))


def left_join(
    left: DataFrame, right: DataFrame, key: str, null_safe: bool = False, last: str = LAST_COLUMN,
    hot_left: Hot = Hot(), hot_right: Hot = Hot(),
) -> DataFrame:
    """Left equi join on ``key``; on a name clash the left column stays.

    Only the columns the left side lacks are taken from the right, so clashing
    columns are pruned at its scan. The physical join is left to Spark: it
    broadcasts a right side whose measured size is below the limit, and splits
    skewed keys of a shuffled join at run time. Missing keys match nothing unless
    ``null_safe`` is set.

    Known hot keys are spread: rows with a key that is hot on their side are dealt into
    parts, and each row of the other side with that key meets every part. A key that is hot on the
    right has matches, so copies of left rows that meet none in their part are left out.
    """
    known = {c.lower() for c in left.columns}
    added = [c for c in right.columns if c.lower() not in known]
    other = right.select(column(key).alias(RIGHT_KEY), *[column(c) for c in added])
    here, there = column(key), F.col(RIGHT_KEY)
    same = here.eqNullSafe(there) if null_safe else here == there
    names = left.columns + added
    if hot_left == Hot() and hot_right == Hot():
        return move_last(left.join(other, same, "left").select(*[column(c) for c in names]), last)
    # A missing key that matches nothing is dealt on the left, and nothing of it is copied.
    left = left.select("*", F.when(hot_left.has(here), _part(left, hot_left.parts)).otherwise(0).alias(LEFT_PART)).select(
        "*", _copies(hot_right.has(here, null_safe), hot_right.parts).alias(RIGHT_PART))
    other = other.select("*", F.when(hot_right.has(there, null_safe), _part(other, hot_right.parts)).otherwise(0).alias(f"{RIGHT_PART}_")).select(
        "*", _copies(hot_left.has(there, null_safe), hot_left.parts).alias(f"{LEFT_PART}_"))
    same = same & (F.col(LEFT_PART) == F.col(f"{LEFT_PART}_")) & (F.col(RIGHT_PART) == F.col(f"{RIGHT_PART}_"))
    joined = left.join(other, same, "left").filter(~hot_right.has(here, null_safe) | F.col(f"{LEFT_PART}_").isNotNull())
    return move_last(joined.select(*[column(c) for c in names]), last)


def find_score_table(tables: Mapping[str, DataFrame], score: str) -> str | None:
    """Name of the first table that has the score column."""
    return next((name for name, df in tables.items() if score in df.columns), None)


def other_tables(tables: Mapping[str, DataFrame], name: str) -> dict[str, DataFrame]:
    return {n: df for n, df in tables.items() if n != name}


def star_join(
    tables: Mapping[str, DataFrame],
    score: str,
    keys: Sequence[str] | None = None,
    null_safe: bool = False,
    hot_share: float = HOT_SHARE,
) -> dict[str, DataFrame]:
    """The score table joined with each other table, and with all of them as ``full_merged``.

    ``full_merged`` adds the raw other tables to the base one after the other, so a
    base row stays one row for every unique key. Tables without a common key are
    left out. Without a score table the result is empty. Keys that hold ``hot_share`` of
    a table's rows are found by sketches first and spread in every join.
    """
    base_name = find_score_table(tables, score)
    if base_name is None:
        return {}
    base = tables[base_name]
    result = {base_name: base}
    by_key: dict[str, list[DataFrame]] = {}
    hot_base: dict[str, Hot] = {}
    for name, other in other_tables(tables, base_name).items():
        key = merge_key(base.columns, other.columns, keys)
        if key is None:
            continue
        hot_base.setdefault(key, hot_keys(base, key, hot_share))
        result[name] = left_join(base, other, key, null_safe, hot_left=hot_base[key], hot_right=hot_keys(other, key, hot_share))
        by_key.setdefault(key, []).append(other)
    if by_key:
        full = base
        for key, others in by_key.items():
            side = side_by_side(others, key, null_safe, hot_share)
            full = left_join(full, side, key, null_safe, hot_left=hot_base[key], hot_right=hot_keys(side, key, hot_share))
        result["full_merged"] = full
    return result


def side_by_side(tables: Sequence[DataFrame], key: str, null_safe: bool = False, hot_share: float = HOT_SHARE) -> DataFrame:
    """Tables with one key as one: what a left join would meet in each of them, one after the other.

    The base is then shuffled once per key. A full join would keep a hot key whole; here the rows of a further
    table either join from the left, where hot keys are spread, or have a key that is new and are added as they are.
    """
    merged = tables[0]
    for other in tables[1:]:
        known = {c.lower() for c in merged.columns}
        added = [c for c in other.columns if c.lower() not in known]
        right = other.select(column(key), *[column(c) for c in added])
        joined = left_join(
            merged, right, key, null_safe, "", hot_keys(merged, key, hot_share), hot_keys(right, key, hot_share))
        seen = merged.select(column(key).alias(RIGHT_KEY)).distinct()
        same = column(key).eqNullSafe(F.col(RIGHT_KEY)) if null_safe else column(key) == F.col(RIGHT_KEY)
        new = right.join(seen, same, "left_anti")
        none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in merged.schema.fields if f.name != key}
        merged = joined.unionByName(new.select(*[none.get(c, column(c)) for c in joined.columns]))
    return merged


def membership(df: DataFrame, members: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Flag the rows whose key occurs in ``members``; duplicates there add no rows."""
    marks = members.select(*[column(k) for k in keys]).distinct().withColumn(name, F.lit(True))
    return df.join(marks, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))
