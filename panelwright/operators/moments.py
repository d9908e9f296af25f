"""Pairwise sums of numeric columns, correlation, and the columns it makes redundant."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.names import column
from panelwright.operators.frequencies import WIDE_LIMIT, encode_nominal, long_double
from panelwright.session import written_once

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
_SUM_SCHEMA = "i int, j int, " + ", ".join(f"{s} double" for s in SUMS)
# Columns per block; one task holds four block x block matrices of doubles.
BLOCK = 1500
# Bytes of partial sums one pass may shuffle.
SHUFFLE_BUDGET = 64 << 30
# A variance below this share of the raw square sum is rounding noise of a constant.
_NOISE = 1e-12


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Number and boolean columns in table order."""
    wanted = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, wanted) and f.name not in exclude]


def text_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Mean per column, 0 where there is none."""
    if len(columns) <= WIDE_LIMIT:
        value = [column(n).cast("double") for n in columns]
        row = df.agg(*[F.avg(F.when(~F.isnan(v), v)).alias(f"m{k}") for k, v in enumerate(value)]).first()
        means = dict(zip(columns, row))
    else:
        rows = long_double(df, columns).groupBy("col").agg(F.avg("value").alias("mean")).collect()
        means = {r["col"]: r["mean"] for r in rows}
    return {n: m if (m := means.get(n)) is not None and np.isfinite(m) else 0.0 for n in columns}


def _matrix(batch: pa.RecordBatch, positions: Sequence[int], shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(present flags, shifted values with 0 for missing) of the chosen columns."""
    columns = [batch.column(p).to_numpy(zero_copy_only=False) for p in positions]
    values = np.column_stack(columns).astype(np.float64, copy=False) - shifts
    present = ~np.isnan(values)
    return present.astype(np.float64), np.where(present, values, 0.0)


def _block_sums(first: Sequence[int], second: Sequence[int], shifts: Sequence[float]):
    """Task function: the pair sums of ``first`` x ``second`` over all rows of one task."""
    left_ids, right_ids = np.asarray(first), np.asarray(second)
    shift = np.asarray(shifts, dtype=np.float64)
    alone = list(first) == list(second)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(SUMS), len(first), len(second)))
        left_positions = range(len(first))
        right_positions = left_positions if alone else range(len(first), len(first) + len(second))
        for batch in batches:
            mx, x = _matrix(batch, left_positions, shift[left_ids])
            my, y = (mx, x) if alone else _matrix(batch, right_positions, shift[right_ids])
            total[0] += mx.T @ my
            total[1] += x.T @ my
            total[2] += mx.T @ y
            total[3] += (x * x).T @ my
            total[4] += mx.T @ (y * y)
            total[5] += x.T @ y
        rows, cols = np.nonzero(left_ids[:, None] >= right_ids[None, :])
        i = pa.array(left_ids[rows], pa.int32())
        j = pa.array(right_ids[cols], pa.int32())
        sums = [pa.array(total[k][rows, cols]) for k in range(len(SUMS))]
        yield pa.RecordBatch.from_arrays([i, j, *sums], ["i", "j", *SUMS])

    return run


def pair_sums(
    df: DataFrame, columns: Sequence[str], shifts: Mapping[str, float] | None = None, block: int = BLOCK
) -> DataFrame:
    """``(i, j, n, sx, sy, sxx, syy, sxy)`` for i >= j over rows where both columns are present.

    ``i`` and ``j`` are places in ``columns``; sums are about ``shifts``. Each task
    multiplies its Arrow batches as matrices and returns one partial triangle, so the
    shuffle carries (tasks x pairs) rows whatever the number of input rows. Scan
    partitions are merged only when all their triangles together would pass
    ``SHUFFLE_BUDGET``; wide tables are cut into column blocks so that one task never
    holds more than ``block`` x ``block`` sums.
    """
    shift = [float((shifts or {}).get(n, 0.0)) for n in columns]
    starts = range(0, len(columns), block)
    groups = [list(range(s, min(s + block, len(columns)))) for s in starts]
    cores = df.sparkSession.sparkContext.defaultParallelism
    triangle = min(len(columns), block) ** 2 * 8 * (len(SUMS) + 1)
    tasks = max(2 * cores, SHUFFLE_BUDGET // max(triangle, 1))
    parts = None
    for a, first in enumerate(groups):
        for second in groups[: a + 1]:
            ids = first if first == second else first + second
            values = df.select(*[column(columns[k]).cast("double").alias(f"c{k}") for k in ids])
            part = values.coalesce(tasks).mapInArrow(_block_sums(first, second, shift), _SUM_SCHEMA)
            parts = part if parts is None else parts.unionAll(part)
    return parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])


def _pearson() -> Column:
    n, sx, sy, sxx, syy, sxy = (F.col(s) for s in SUMS)
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    spread = (vx > _NOISE * n * sxx) & (vy > _NOISE * n * syy) & (n > 1)
    r = (n * sxy - sx * sy) / (F.sqrt(vx) * F.sqrt(vy))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))
    return F.when(spread & ~F.isnan(r), bounded)


def correlations(df: DataFrame, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``(i, j, col_i, col_j, n, r)``: Pearson over pairwise complete rows, i > j.

    Values are taken about their mean first, because raw square sums of large ids
    lose the digits that matter. A column without spread has a NULL correlation.
    """
    columns = list(columns)
    sums = pair_sums(df, columns, column_means(df, columns), block)
    names = F.array(*[F.lit(n) for n in columns])
    return sums.filter(F.col("i") > F.col("j")).select(
        "i", "j",
        F.get(names, F.col("i")).alias("col_i"), F.get(names, F.col("j")).alias("col_j"),
        F.col("n").cast("long").alias("n"), _pearson().alias("r"),
    )


def absolute_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return correlations(df, columns).withColumn("r", F.abs("r"))


def correlated_pairs(corr: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (later column, earlier column) above the threshold; expects absolute or signed r."""
    return corr.filter(F.abs("r") > threshold)


def redundant_columns(
    df: DataFrame,
    threshold: float = 1.0,
    target: str | None = None,
    protected: Sequence[str] = (),
    strict_reference: bool = False,
) -> list[str]:
    """One column of every pair with |r| above the threshold, in table order.

    With a target, the column less correlated with it goes (a tie drops the earlier
    one); without, the earlier one goes. A dropped column still counts in other
    pairs, so the result does not depend on any order. ``strict_reference`` ignores
    the target, as the compared tool does in effect.
    """
    if threshold >= 1.0:
        return []
    out = [target] if target else []
    if not strict_reference:
        out += list(protected)
    texts = text_columns(df, out)
    names = [n for n in df.columns if n in set(numeric_columns(df, out)) | set(texts)]
    if not names:
        return []
    guided = bool(target) and not strict_reference and target in numeric_columns(df)
    frame = df.select(*[column(n) for n in names], *([column(target)] if guided else []))
    # Means and sums each read the codes; they are narrow, the look-ups behind them are not.
    encoded = written_once(encode_nominal(frame, texts), "codes") if texts else frame
    corr = correlations(encoded, names + ([target] if guided else []))
    last = len(names)
    wanted = (F.col("i") < last) & (F.abs("r") > threshold) | (F.col("i") == last)
    strong = written_once(corr.filter(wanted).select("i", "j", F.abs("r").alias("r")), "correlations")
    # One row per column and its correlation with the target: the schema bounds what is broadcast.
    to_target = strong.filter(F.col("i") == last)
    later, earlier = (to_target.select(F.col("j").alias(k), F.col("r").alias(f"{k}_r")) for k in ("i", "j"))
    pairs = strong.filter(F.col("i") < last).select("i", "j")
    judged = pairs.join(F.broadcast(later), "i", "left").join(F.broadcast(earlier), "j", "left")
    weaker = F.when(F.col("i_r") < F.col("j_r"), F.col("i")).otherwise(F.col("j"))
    # Only the columns to drop reach the driver.
    return [names[r["k"]] for r in judged.select(weaker.alias("k")).distinct().orderBy("k").collect()]


def drop_correlated(
    df: DataFrame,
    threshold: float = 1.0,
    target: str | None = None,
    protected: Sequence[str] = (),
    strict_reference: bool = False,
) -> tuple[DataFrame, list[str]]:
    dropped = redundant_columns(df, threshold, target, protected, strict_reference)
    return df.drop(*dropped), dropped
