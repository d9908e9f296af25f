"""Exact values at given places of sorted columns, without sorting them.

All columns are narrowed together. One scan counts the values by sign and binary exponent; every later scan splits only the bins
that hold a wanted place, evenly between their least and greatest value, until a bin holds one value or few rows, which a last
scan reads. Bins follow the order of the values, so the counts are exact, and the map tasks sum them before the shuffle: what is
shuffled and what reaches the driver is bounded by columns, places and bins, never by rows. A bin of one exponent has 52 bits, and
each scan takes ten of them at least, so the number of scans is bounded too.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.names import column

# Bins of a scan per wanted place, rows of a bin that are few enough to be read, columns narrowed in one job.
BINS = 1024
FEW_ROWS = 1024
COLUMNS_AT_ONCE = 20
# Above any binary exponent of a double.
EXPONENTS = 2000


class Bin(NamedTuple):
    """Neighbouring values of one column: its number, rows, least and greatest value, rows of the column below it."""

    col: int
    rows: int
    least: float
    greatest: float
    below: int


def _number(name: str) -> Column:
    value = column(name).cast("double")
    return F.when(~F.isnan(value), value)


def _exponent(value: Column) -> Column:
    """A number that grows with the value: zero for zero, then sign and binary exponent."""
    size = F.coalesce(F.floor(F.log2(F.abs(value))) + EXPONENTS, F.lit(0))
    infinite = F.abs(value) == float("inf")
    return (F.when(infinite, 2 * EXPONENTS).otherwise(size) * F.signum(value)).cast("int")


def _bins(rows: DataFrame, keys: list[str]) -> list[tuple]:
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)), F.min("value"), F.max("value"))
    return sorted(tuple(r) for r in found.collect())


def _holding(bins: list[tuple[int, int, float, float]], col: int, below: int, places: Sequence[int]) -> dict[int, Bin]:
    """For each place the bin that holds it; ``bins`` are ``(order, rows, least, greatest)`` in order."""
    found: dict[int, Bin] = {}
    for _, rows, least, greatest in bins:
        for place in places:
            if below <= place < below + rows:
                found[place] = Bin(col, rows, least, greatest, below)
        below += rows
    return found


def _in_bins(df: DataFrame, names: Sequence[str], bins: Sequence[Bin]) -> DataFrame:
    """``(bin, value)`` of the rows that lie in one of the bins."""
    cells = []
    for k, name in enumerate(names):
        value = _number(name)
        places = [F.when(value.between(b.least, b.greatest), number) for number, b in enumerate(bins) if b.col == k]
        if places:
            cells.append(F.struct(F.coalesce(*places).alias("bin"), value.alias("value")))
    return df.select(F.inline(F.array(*cells))).filter("bin IS NOT NULL")


def values_at_places(df: DataFrame, columns: Sequence[str], places_of) -> list[tuple[int, dict[int, float]]]:
    """Per column the number of present values, and the value at each 0-based place that ``places_of(number)`` names."""
    result: list[tuple[int, dict[int, float]]] = []
    for start in range(0, len(columns), COLUMNS_AT_ONCE):
        result += _some_columns(df, list(columns[start : start + COLUMNS_AT_ONCE]), places_of)
    return result


def _some_columns(df: DataFrame, names: list[str], places_of) -> list[tuple[int, dict[int, float]]]:
    cells = F.array(*[F.struct(F.lit(k).alias("col"), _number(n).alias("value")) for k, n in enumerate(names)])
    present = df.select(F.inline(cells)).filter("value IS NOT NULL")
    first = _bins(present.withColumn("order", _exponent(F.col("value"))), ["col", "order"])
    counts, values, open_ = [0] * len(names), [{} for _ in names], {}
    for k in range(len(names)):
        mine = [row[1:] for row in first if row[0] == k]
        counts[k] = sum(row[1] for row in mine)
        open_ |= {(k, place): b for place, b in _holding(mine, k, 0, places_of(counts[k])).items()}
    while open_:
        for (k, place), b in list(open_.items()):
            if b.least == b.greatest:
                values[k][place] = b.least
                del open_[k, place]
        wide = sorted({b for b in open_.values() if b.rows > FEW_ROWS})
        if not wide:
            break
        ends = [F.array(*[F.lit(x) for x in side]) for side in ([b.least for b in wide], [b.greatest for b in wide])]
        low, high = (F.get(side, F.col("bin")) for side in ends)
        order = F.least(F.floor((F.col("value") - low) / (high - low) * BINS), F.lit(BINS - 1)).cast("int")
        split = _bins(_in_bins(df, names, wide).withColumn("order", order), ["bin", "order"])
        for number, b in enumerate(wide):
            mine = [row[1:] for row in split if row[0] == number]
            wanted = [place for (k, place), other in open_.items() if other == b]
            open_ |= {(b.col, place): inner for place, inner in _holding(mine, b.col, b.below, wanted).items()}
    few = sorted(set(open_.values()))
    if few:
        rows = _in_bins(df, names, few).groupBy("bin", "value").agg(F.count(F.lit(1)).alias("n")).collect()
        for number, b in enumerate(few):
            mine = sorted((r["value"], r["n"], r["value"], r["value"]) for r in rows if r["bin"] == number)
            wanted = [place for (k, place), other in open_.items() if other == b]
            values[b.col].update({place: inner.least for place, inner in _holding(mine, b.col, b.below, wanted).items()})
    return list(zip(counts, values))


def selected_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> list[list[float] | None]:
    """Exact quantiles of each column with linear interpolation; None for a column without values."""
    def places(total: int) -> list[int]:
        return sorted({edge((total - 1) * p) for p in probabilities for edge in (floor, ceil)}) if total else []

    found = []
    for total, at in values_at_places(df, columns, places):
        between = []
        for p in probabilities if total else ():
            place = (total - 1) * p
            low, high = at[floor(place)], at[ceil(place)]
            between.append(low if low == high else low + (high - low) * (place - floor(place)))
        found.append(between or None)
    return found
