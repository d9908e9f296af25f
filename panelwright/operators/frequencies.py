"""Value frequencies of all columns in one shuffle, and what follows from them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.names import column
from panelwright.operators.dictionary import FOUND, KEY, PLACE, dictionary_rows, look_up
from panelwright.operators.positions import top_per_group, with_row_number

OTHER = "__OTHER__"
# Above this many columns a long (unpivoted) aggregate plans and compiles faster than a wide one.
WIDE_LIMIT = 60
# Columns with at most this many classes are encoded from a literal list.
INLINE_CLASSES = 64
# Frequent-items sketches: tracked items, columns per scan, and the smallest share they
# report without a miss (their error is below 0.4 % of the rows at this size).
SKETCH_ITEMS = 1000
SKETCH_COLUMNS = 200
SKETCH_SHARE = 0.02


def long_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(col, value) with every value as text, missing values kept as NULL."""
    names = list(columns if columns is not None else df.columns)
    texts = df.select(*[column(n).cast("string").alias(n) for n in names])
    return texts.unpivot([], [column(n) for n in names], "col", "value")


def long_double(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col, value) with every value as double; NaN becomes NULL."""
    values = df.select(*[column(n).cast("double").alias(n) for n in columns])
    pairs = values.unpivot([], [column(n) for n in columns], "col", "value")
    return pairs.select("col", F.when(~F.isnan("value"), F.col("value")).alias("value"))


def value_frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(col, value, n)``: partial counts in the map tasks, one shuffle for all columns."""
    return long_text(df, columns).groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))


def missing_ratios(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(col, total, missing, ratio)``; only one partial row per column and task is shuffled."""
    names = list(columns if columns is not None else df.columns)
    flags = df.select(*[column(n).isNull().cast("long").alias(n) for n in names])
    pairs = flags.unpivot([], [column(n) for n in names], "col", "flag")
    return pairs.groupBy("col").agg(
        F.count("flag").alias("total"), F.sum("flag").alias("missing"), F.avg("flag").alias("ratio")
    )


def uniformity_ratios(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(col, present, top, ratio)``; a column without any value has a NULL ratio."""
    counted = F.when(F.col("value").isNotNull(), F.col("n"))
    sums = value_frequencies(df, columns).groupBy("col").agg(
        F.coalesce(F.sum(counted), F.lit(0)).alias("present"), F.max(counted).alias("top")
    )
    return sums.withColumn("ratio", F.try_divide("top", "present"))


def sparse_columns(df: DataFrame, threshold: float, protected: Sequence[str] = ()) -> list[str]:
    """Columns whose missing share is above the threshold, in table order."""
    names = [n for n in df.columns if n not in protected]
    if threshold >= 1.0 or not names:
        return []
    rows = missing_ratios(df, names).filter(F.col("ratio") > threshold).select("col").collect()
    found = {r["col"] for r in rows}
    return [n for n in names if n in found]


def _long_typed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(col, whole, number, text)``: each value in the one field that keeps its meaning, the others NULL."""
    def row(name: str) -> Column:
        kind = df.schema[name].dataType
        whole = isinstance(kind, T.IntegralType)
        number = isinstance(kind, (T.DoubleType, T.FloatType))
        return F.struct(
            F.lit(name).alias("col"), (column(name) if whole else F.lit(None)).cast("bigint").alias("whole"),
            (column(name) if number else F.lit(None)).cast("double").alias("number"),
            (F.lit(None) if whole or number else column(name)).cast("string").alias("text"),
        )

    return df.select(F.inline(F.array(*[row(n) for n in columns])))


def constant_columns(df: DataFrame, names: Sequence[str], wide_limit: int = WIDE_LIMIT) -> list[str]:
    """Columns with exactly one distinct value; a scan with map-side min/max, no row shuffle.

    Values are compared in their own type in the wide and the long form, so ``0.0`` equals ``-0.0`` in both.
    """
    if not names:
        return []
    if len(names) <= wide_limit:
        same = [F.min(column(n)) == F.max(column(n)) for n in names]
        row = df.agg(*[s.alias(f"c{k}") for k, s in enumerate(same)]).first()
        return [n for n, flag in zip(names, row) if flag]
    equal = [F.min(c) == F.max(c) for c in ("whole", "number", "text")]
    rows = (
        _long_typed(df, names).groupBy("col").agg(F.coalesce(*equal).alias("same"))
        .filter("same").select("col").collect()
    )
    found = {r["col"] for r in rows}
    return [n for n in names if n in found]


def _comparable(df: DataFrame, name: str) -> Column:
    """The column in a type whose values compare exactly to a literal."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.StringType, T.BooleanType, T.DoubleType, T.IntegralType)):
        return column(name)
    return column(name).cast("double" if isinstance(kind, T.FloatType) else "string")


def frequent_values(df: DataFrame, names: Sequence[str], share: float) -> list[tuple[str, object]]:
    """(column, value) pairs that may hold at least ``share`` of the column's present values.

    A frequent-items sketch per column: bounded in size, merged without shuffling
    rows. Its counts never fall short of the true ones, and with this many tracked
    items a value of the wanted share is always reported, so nothing is missed.
    """
    k = math.ceil(2 / share)
    found = []
    for start in range(0, len(names), SKETCH_COLUMNS):
        part = names[start : start + SKETCH_COLUMNS]
        values = df.select(*[_comparable(df, n).alias(f"c{i}") for i, n in enumerate(part)])
        facts = [e for i in range(len(part)) for e in (
            F.count(f"c{i}").alias(f"n{i}"), F.expr(f"approx_top_k(c{i}, {k}, {SKETCH_ITEMS})").alias(f"t{i}"))]
        row = values.agg(*facts).first()
        for i, n in enumerate(part):
            found += [(n, t["item"]) for t in row[f"t{i}"] or () if t["item"] is not None and t["count"] >= share * row[f"n{i}"]]
    return found


def uniform_columns(df: DataFrame, threshold: float = 1.0, protected: Sequence[str] = ()) -> list[str]:
    """Columns whose most frequent value reaches the threshold share of the present values.

    A share of 1.0 means one distinct value, which min/max answers. For lower shares
    a sketch names the few values that can reach it, and a second scan counts those
    exactly; only shares below the sketch's reach need the frequency shuffle.
    Columns without values are skipped.
    """
    names = [n for n in df.columns if n not in protected]
    if threshold > 1.0 or not names:
        return []
    if threshold == 1.0:
        return constant_columns(df, names)
    if threshold < SKETCH_SHARE:
        rows = uniformity_ratios(df, names).filter(F.col("ratio") >= threshold).select("col").collect()
        found = {r["col"] for r in rows}
        return [n for n in names if n in found]
    candidates = frequent_values(df, names, threshold)
    found = set()
    for start in range(0, len(candidates), WIDE_LIMIT):
        part = candidates[start : start + WIDE_LIMIT]
        ratios = [F.count_if(_comparable(df, n) == F.lit(v)) / F.count(column(n)) for n, v in part]
        row = df.agg(*[r.alias(f"r{k}") for k, r in enumerate(ratios)]).first()
        found |= {n for (n, _), r in zip(part, row) if r >= threshold}
    return [n for n in names if n in found]


def drop_sparse(df: DataFrame, threshold: float, protected: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    dropped = sparse_columns(df, threshold, protected)
    return df.drop(*dropped), dropped


def drop_uniform(df: DataFrame, threshold: float = 1.0, protected: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    dropped = uniform_columns(df, threshold, protected)
    return df.drop(*dropped), dropped


def _classes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct ``(col, value)``; missing values form the class ``nan``."""
    return long_text(df, columns).select("col", F.coalesce("value", F.lit("nan")).alias("value")).distinct()


def nominal_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(col, value, code)``: 0-based place of each distinct text in binary order."""
    numbered = with_row_number(_classes(df, columns), ["col"], [F.col("value")], "code")
    return numbered.withColumn("code", F.col("code") - 1)


def _listed_classes(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, list[str]]:
    """The classes of the columns that have at most ``limit``, in order.

    A cardinality sketch first rules out the columns that are clearly beyond it, so that their values are never shuffled.
    """
    classes: dict[str, list[str]] = {}
    for start in range(0, len(columns), SKETCH_COLUMNS):
        part = columns[start : start + SKETCH_COLUMNS]
        row = df.agg(*[F.approx_count_distinct(column(n).cast("string")).alias(f"n{k}") for k, n in enumerate(part)]).first()
        classes |= {n: [] for n, estimate in zip(part, row) if estimate <= 2 * limit}
    if not classes:
        return {}
    first = top_per_group(_classes(df, list(classes)), ["col"], [F.col("value")], limit + 1, "place")
    for row in first.orderBy("col", "place").collect():
        classes[row["col"]].append(row["value"])
    return {n: values for n, values in classes.items() if len(values) <= limit}


def encode_nominal(df: DataFrame, columns: Sequence[str], inline_limit: int = INLINE_CLASSES) -> DataFrame:
    """Replace each named column by its code.

    Columns with few classes look their code up in a literal list, all in one
    ``select``. The distinct texts of all others are sorted once, and all their cells
    get their codes in one exchange by digest, see :func:`look_up`.
    """
    columns = list(columns)
    classes = _listed_classes(df, columns, inline_limit)
    many = [n for n in columns if n not in classes]

    def key(name: str) -> Column:
        return F.coalesce(column(name).cast("string"), F.lit("nan"))

    def inline(name: str) -> Column:
        listed = F.array(*[F.lit(v) for v in classes[name]])
        return (F.array_position(listed, key(name)) - 1).cast("bigint").alias(name)

    # A column of an empty table has no classes, but its codes are numbers all the same.
    none = F.lit(None).cast("bigint")
    done = [column(n) if n not in classes else inline(n) if classes[n] else none.alias(n) for n in df.columns]
    if not many:
        return df.select(*done)
    # The texts are sorted, but only their digests are written in that order.
    place = F.array_position(F.array(*[F.lit(n) for n in many]), F.col("col")) - 1
    texts_of = _classes(df, many).select("value", *dictionary_rows(place, F.col("value"), F.lit(None))[:2])
    numbered = with_row_number(texts_of, [PLACE], [F.col("value")], FOUND, [PLACE, KEY])
    dictionary = numbered.withColumn(FOUND, F.col(FOUND) - 1)
    # The texts stay behind: only their digests are written with the row.
    texts = [f"__text{k}" for k in range(len(many))]
    rows = df.select(*[d for d, n in zip(done, df.columns) if n not in many], *[key(n).alias(t) for n, t in zip(many, texts)])
    found, values = look_up(rows, [F.col(t) for t in texts], dictionary, drop=texts)
    code = dict(zip(many, values))
    return found.select(*[code[n].alias(n) if n in code else column(n) for n in df.columns])


def categorical_profile(df: DataFrame, columns: Sequence[str], top: int = 20) -> DataFrame:
    """One row per column: distinct count, most common value, top values and the rest."""
    counts = value_frequencies(df, columns).filter(F.col("value").isNotNull())
    totals = counts.groupBy("col").agg(F.count(F.lit(1)).alias("unique_count"), F.sum("n").alias("present"))
    ranked = top_per_group(counts, ["col"], [F.desc("n"), F.col("value")], top, "place")
    tops = ranked.groupBy("col").agg(
        F.sort_array(F.collect_list(F.struct("place", "value", "n"))).alias("tops"), F.sum("n").alias("top_sum")
    )
    names = df.sparkSession.createDataFrame([(n,) for n in columns], "col string")
    listed = F.transform("tops", lambda t: F.struct(t["value"].alias("value"), t["n"].alias("count")))
    rest = F.array(F.struct(F.lit(OTHER).alias("value"), (F.col("present") - F.col("top_sum")).alias("count")))
    empty = F.array().cast("array<struct<value:string,count:bigint>>")
    return names.join(totals, "col", "left").join(tops, "col", "left").select(
        F.col("col").alias("name"),
        F.coalesce("unique_count", F.lit(0)).cast("long").alias("unique_count"),
        F.col("tops")[0]["value"].alias("most_common"),
        F.col("tops")[0]["n"].alias("most_common_count"),
        F.when(F.col("unique_count") > top, F.concat(listed, rest)).when(F.col("tops").isNotNull(), listed)
        .otherwise(empty).alias("value_counts"),
    )
