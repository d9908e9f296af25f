"""Exact positions in a sorted order without pulling a whole group into one task.

``row_number`` over a group sorts that group in one task, and one group may hold a
large part of all rows. Here the rows are range-partitioned on (group, order), so
a large group spreads over many tasks; each range is numbered on its own and the
totals of the ranges before it are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.names import column, quoted
from panelwright.session import written_once

RANGE, SEQUENCE, FIRST = "__range", "__sequence", "__first"
ROWS, INSIDE, BEFORE = "__rows", "__inside", "__before"


def sorted_table(df: DataFrame, group: Sequence[str], order: Sequence[Column], kept: Sequence[str] | None = None) -> DataFrame:
    """The rows with the number of their sorted range and their sequence, written once, with the ``kept`` columns only.

    Range bounds are sampled, so they may differ between two runs of one plan. The
    table in the shared folder makes all later reads see the same ranges.
    """
    ranges = df.orderBy(*[column(g) for g in group], *order)
    return written_once(ranges.select(
        *[column(c) for c in kept or df.columns], F.spark_partition_id().alias(RANGE), F.monotonically_increasing_id().alias(SEQUENCE)
    ), "sorted")


def range_totals(ranges: DataFrame, group: Sequence[str], weight: Column) -> DataFrame:
    """Per (range, group): first sequence number, rows, weight, and the group's weight in earlier ranges.

    A group fills a run of neighbouring ranges, so this table has at most
    (number of ranges + number of groups) rows and every window partition at most
    one row per range.
    """
    keys = [column(g) for g in group]
    sums = ranges.groupBy(*keys, RANGE).agg(
        F.sum(weight).alias(INSIDE), F.count(F.lit(1)).alias(ROWS), F.min(SEQUENCE).alias(FIRST)
    )
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn(BEFORE, F.coalesce(F.sum(INSIDE).over(earlier), F.lit(0)))


def with_row_number(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, kept: Sequence[str] | None = None
) -> DataFrame:
    """Add the 1-based position inside each group; ``order`` must be a total order.

    With ``kept`` (the group among them) only those columns are written and returned.

    Sequence numbers count up inside a range, so the place in the range is a
    difference and no window over the rows is needed.
    """
    ranges = sorted_table(df, group, order, kept)
    left, right = ranges.alias("l"), range_totals(ranges, group, F.lit(1)).alias("r")
    same = F.col(f"l.{RANGE}") == F.col(f"r.{RANGE}")
    for g in group:
        same = same & F.col(f"l.{quoted(g)}").eqNullSafe(F.col(f"r.{quoted(g)}"))
    number = F.col(f"l.{SEQUENCE}") - F.col(f"r.{FIRST}") + 1 + F.col(f"r.{BEFORE}")
    return left.join(right, same).select(*[F.col(f"l.{quoted(c)}") for c in kept or df.columns], number.alias(name))


def rows_at_places(ranges: DataFrame, totals: DataFrame, group: str, weight: str, places: Column) -> DataFrame:
    """Rows of a :func:`sorted_table` that cover given 0-based places of their group.

    ``totals`` are its :func:`range_totals`.
    ``places`` is an array computed from ``total``, the weight of the group. Only the
    ranges that hold a wanted place are read in order; each adds its running weight
    to the weight of the ranges before it.
    """
    sums = totals.groupBy(group).agg(F.sum(INSIDE).alias("total"))
    wanted = totals.join(sums, group).withColumn("place", F.explode(places)).filter(
        (F.col("place") >= F.col(BEFORE)) & (F.col("place") < F.col(BEFORE) + F.col(INSIDE))
    )
    opened = wanted.select(group, RANGE, BEFORE).distinct()
    in_order = Window.partitionBy(group, RANGE).orderBy(SEQUENCE)
    upto = F.col(BEFORE) + F.sum(weight).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    running = ranges.join(opened, [group, RANGE]).withColumn("upto", upto)
    hits = running.join(wanted.select(group, RANGE, "place", "total"), [group, RANGE]).filter(
        (F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col(weight))
    )
    return hits.drop(RANGE, SEQUENCE, BEFORE, "upto")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, name: str) -> DataFrame:
    """The first ``n`` rows of each group with their position.

    Spark keeps at most ``n`` rows per group in every map task before the shuffle
    (WindowGroupLimit), so a large group costs no more than a small one.
    """
    place = F.row_number().over(Window.partitionBy(*[column(g) for g in group]).orderBy(*order))
    return df.withColumn(name, place).filter(F.col(name) <= n)
