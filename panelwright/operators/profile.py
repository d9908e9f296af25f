"""Column profiles: common counts, numeric summary, exact quantiles, histogram, categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.names import column
from panelwright.operators.frequencies import WIDE_LIMIT, categorical_profile, long_double
from panelwright.operators.moments import numeric_columns
from panelwright.operators.selection import selected_quantiles

QUARTILES = (0.25, 0.5, 0.75)
BINS = 30


def common_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(name, dtype, total_count, missing_count, missing_percentage, non_missing_count)``."""
    names = list(columns if columns is not None else df.columns)
    types = dict(df.dtypes)
    flags = []
    for n in names:
        missing = column(n).isNull()
        if types[n] in ("double", "float"):
            missing = missing | F.isnan(column(n))
        flags.append(missing.cast("long").alias(n))
    sums = (
        df.select(*flags).unpivot([], [column(n) for n in names], "name", "flag")
        .groupBy("name").agg(F.count("flag").alias("total_count"), F.sum("flag").alias("missing_count"))
    )
    described = df.sparkSession.createDataFrame([(n, types[n]) for n in names], "name string, dtype string")
    share = F.col("missing_count") / F.col("total_count") * 100
    return described.join(sums, "name", "left").select(
        "name", "dtype",
        F.coalesce("total_count", F.lit(0)).alias("total_count"),
        F.coalesce("missing_count", F.lit(0)).alias("missing_count"),
        share.alias("missing_percentage"),
        F.coalesce(F.col("total_count") - F.col("missing_count"), F.lit(0)).alias("non_missing_count"),
    )


def number_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(col, value double, n)`` of the present numbers."""
    pairs = long_double(df, columns).filter(F.col("value").isNotNull())
    return pairs.groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))


def _moments(value: Column) -> list[Column]:
    return [
        F.count(value).alias("present"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.var_samp(value).alias("variance"), F.min(value).alias("min"), F.max(value).alias("max"),
    ]


def numeric_moments(df: DataFrame, columns: Sequence[str], wide_limit: int = WIDE_LIMIT) -> DataFrame:
    """``(col, present, mean, std, variance, min, max)``, one partial row per task and no row shuffle.

    Every column has a row, also in an empty table.
    """
    if len(columns) > wide_limit:
        found = long_double(df, columns).groupBy("col").agg(*_moments(F.col("value")))
        names = df.sparkSession.createDataFrame([(n,) for n in columns], "col string")
        return names.join(found, "col", "left").withColumn("present", F.coalesce("present", F.lit(0)))
    numbers = {n: column(n).cast("double") for n in columns}
    wide = df.agg(*[F.struct(*_moments(F.when(~F.isnan(v), v))).alias(f"m{k}") for k, v in enumerate(numbers.values())])
    rows = [F.struct(F.lit(n).alias("col"), F.col(f"m{k}.*")) for k, n in enumerate(numbers)]
    return wide.select(F.inline(F.array(*rows)))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = QUARTILES) -> DataFrame:
    """``(col, quantiles array<double>)`` with linear interpolation, by selection; a column without values has no row."""
    found = zip(columns, selected_quantiles(df, columns, probabilities))
    return df.sparkSession.createDataFrame(
        [(n, q) for n, q in found if q is not None], "col string, quantiles array<double>")


def approximate_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = QUARTILES, accuracy: int = 10000
) -> DataFrame:
    """Quantiles from a mergeable sketch of bounded size; no sort of the values."""
    q = F.percentile_approx("value", list(probabilities), accuracy)
    return long_double(df, columns).groupBy("col").agg(q.alias("quantiles"))


def _range(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Histogram range; a constant column is widened by half a unit on both sides."""
    flat = lo == hi
    return F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, hi + 0.5).otherwise(hi)


def value_limits(frequencies: DataFrame) -> DataFrame:
    """``(col, min, max)`` of a frequency table."""
    return frequencies.groupBy("col").agg(F.min("value").alias("min"), F.max("value").alias("max"))


def histogram_counts(frequencies: DataFrame, limits: DataFrame, bins: int = BINS) -> DataFrame:
    """``(col, lo, hi, bin, n)`` for the filled bins, ``bin`` from 0; the last bin is closed.

    The limits are one row per column, so the schema bounds what is broadcast; without an exchange on the
    column, the counts of a column's bins are summed where its values lie first.
    """
    lo, hi = _range(F.col("min"), F.col("max"))
    limits = limits.select("col", lo.alias("lo"), hi.alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    guess = F.least(F.floor((F.col("value") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo")))), F.lit(bins - 1))
    placed = frequencies.join(F.broadcast(limits), "col").withColumn("bin", guess)
    # The product above may land one bin off an edge, so the edges decide.
    down = F.col("value") < F.col("bin") * step + F.col("lo")
    up = (F.col("value") >= (F.col("bin") + 1) * step + F.col("lo")) & (F.col("bin") < bins - 1)
    exact = F.when(down, F.col("bin") - 1).when(up, F.col("bin") + 1).otherwise(F.col("bin"))
    return placed.groupBy("col", "lo", "hi", exact.cast("int").alias("bin")).agg(F.sum("n").alias("n"))


def histograms(frequencies: DataFrame, limits: DataFrame, bins: int = BINS) -> DataFrame:
    """``(col, histogram struct<counts, bin_edges, bins>)`` with empty bins filled."""
    filled = histogram_counts(frequencies, limits, bins).groupBy("col", "lo", "hi").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("filled")
    )
    places = F.sequence(F.lit(0), F.lit(bins - 1))
    counts = F.transform(places, lambda b: F.coalesce(F.try_element_at("filled", b), F.lit(0)).cast("long"))
    step = (F.col("hi") - F.col("lo")) / bins
    edges = F.concat(F.transform(places, lambda b: b * step + F.col("lo")), F.array("hi"))
    packed = F.struct(counts.alias("counts"), edges.alias("bin_edges"), F.lit(bins).alias("bins"))
    return filled.select("col", packed.alias("histogram"))


def distinct_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(col, unique_count)``; values go through the shuffle with the number of their column."""
    cells = F.array(*[F.struct(F.lit(k).alias("place"), column(n).cast("double").alias("value")) for k, n in enumerate(columns)])
    values = df.select(F.inline(cells)).filter("value IS NOT NULL AND NOT isnan(value)").distinct()
    names = F.array(*[F.lit(n) for n in columns])
    return values.groupBy("place").agg(F.count(F.lit(1)).alias("unique_count")).select(F.get(names, F.col("place")).alias("col"), "unique_count")


def numeric_profile(df: DataFrame, columns: Sequence[str], bins: int = BINS, exact: bool = True) -> DataFrame:
    """One row per column: moments, range, quartiles, distinct count, histogram.

    A column without values keeps NULLs, a distinct count of 0 and no histogram. Nothing is sorted or
    written: quartiles are selected by counting, histogram bins are counted where the rows lie.
    ``exact=False`` takes the quartiles from a sketch and spares the scans of the selection.
    """
    columns = list(columns)
    moments = numeric_moments(df, columns)
    quantiles = exact_quantiles(df, columns) if exact else approximate_quantiles(df, columns)
    rows = long_double(df, columns).filter(F.col("value").isNotNull()).withColumn("n", F.lit(1))
    joined = (
        moments.join(quantiles, "col", "left").join(distinct_numbers(df, columns), "col", "left")
        .join(histograms(rows, moments, bins), "col", "left")
    )
    return joined.select(
        F.col("col").alias("name"), "mean", "std", "variance", "min", "max",
        *[F.get("quantiles", F.lit(k)).alias(q) for k, q in enumerate(("q25", "median", "q75"))],
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"), "histogram",
    )


def profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Full profile of every column at once: common part plus the part of its type.

    The whole table is profiled in a fixed number of jobs, so a viewer can look up
    any column without touching the data again.
    """
    names = list(columns if columns is not None else df.columns)
    numbers = [n for n in numeric_columns(df) if n in names]
    others = [n for n in names if n not in numbers]
    kind = F.when(F.col("name").isin(numbers), "numeric").otherwise("categorical")
    result = common_profile(df, names).withColumn("type", kind)
    if numbers:
        result = result.join(numeric_profile(df, numbers, exact=exact), "name", "left")
    if others:
        part = categorical_profile(df, others)
        if numbers:
            part = part.withColumnRenamed("unique_count", "__other_count")
            result = result.join(part, "name", "left").withColumn(
                "unique_count", F.coalesce("unique_count", "__other_count")
            ).drop("__other_count")
        else:
            result = result.join(part, "name", "left")
    return result
