"""Codes to labels, variable names to variable labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.names import column, rename_all
from panelwright.functions.text import strip, strip_once
from panelwright.operators.dictionary import dictionary_rows, look_up

# Variables with at most this many codes are decoded from a literal map.
INLINE_CODES = 64
# Code lists of at most this many rows are small enough to broadcast.
BROADCAST_CODES = 50_000
# So many of them are joined one by one; more share one look-up.
BROADCAST_LISTS = 3


def code_key(c):
    """Codes and values are compared as text without blanks and quotes around them."""
    return strip(F.btrim(strip(c), F.lit("\"'")))


def listed_code_key(c):
    """:func:`code_key` for the rows of a code list."""
    return strip_once(F.btrim(strip_once(c), F.lit("\"'")))


def unique_labels(value_labels: DataFrame) -> DataFrame:
    """``(name, code, label)`` with one label for each code, compared as text."""
    order = [F.col("ordinal")] if "ordinal" in value_labels.columns else []
    keyed = value_labels.select("name", listed_code_key(F.col("code")).alias("code"), "label", *order)
    present = keyed.filter("name IS NOT NULL AND code IS NOT NULL AND label IS NOT NULL")
    last = F.max(F.struct(*order, F.col("label"))).getField("label")
    return present.groupBy("name", "code").agg(last.alias("label"))


def decode_labels(df: DataFrame, value_labels: DataFrame, inline_limit: int = INLINE_CODES) -> DataFrame:
    """Replace codes by labels; values without a label pass through as text.

    ``value_labels`` is ``(name, code, label)``, with an optional ``ordinal``. Codes that
    are equal as text keep one label: that of the highest ordinal, or without one the
    greatest; missing codes match nothing. Variables with few codes are decoded together
    in one projection. A few variables with code lists that are small enough join a broadcast
    list each; otherwise all large variables are looked up in one exchange.
    """
    table = unique_labels(value_labels)
    names = list(df.columns)
    sizes = {
        r["name"]: r["count"]
        for r in table.filter(F.col("name").isin(names)).groupBy("name").count().collect()
    }
    few = [n for n in names if 0 < sizes.get(n, 0) <= inline_limit]
    maps: dict[str, dict[str, str]] = {n: {} for n in few}
    if few:
        for r in table.filter(F.col("name").isin(few)).collect():
            maps[r["name"]][r["code"]] = r["label"]

    def inline(name: str):
        value = column(name).cast("string")
        pairs = F.create_map(*[F.lit(x) for pair in sorted(maps[name].items()) for x in pair])
        return F.coalesce(F.try_element_at(pairs, code_key(value)), value).alias(name)

    result = df.select(*[inline(n) if n in maps else column(n) for n in names])
    large = [n for n in names if sizes.get(n, 0) > inline_limit]
    if len(large) > BROADCAST_LISTS or any(sizes[n] > BROADCAST_CODES for n in large):
        place = F.array_position(F.array(*[F.lit(n) for n in large]), F.col("name")) - 1
        listed = table.filter(F.col("name").isin(large)).select(*dictionary_rows(place, F.col("code"), F.col("label")))
        found, labels = look_up(result, [code_key(column(n).cast("string")) for n in large], listed)
        decoded = {n: F.coalesce(label, column(n).cast("string")).alias(n) for n, label in zip(large, labels)}
        return found.select(*[decoded.get(n, column(n)) for n in names])
    for name in large:
        codes = table.filter(F.col("name") == name).select(
            F.col("code").alias("__code"), F.col("label").alias("__label")
        )
        value = column(name).cast("string")
        decoded = F.coalesce("__label", value).alias(name)
        kept = [decoded if c == name else column(c) for c in names]
        result = result.join(F.broadcast(codes), code_key(value) == F.col("__code"), "left").select(*kept)
    return result


def label_headers(df: DataFrame, variables: Sequence[tuple[str, str | None]]) -> DataFrame:
    """Rename variables to their labels; without a label the name stays."""
    labels = {name: label for name, label in variables}
    return rename_all(df, [labels.get(c) or c for c in df.columns])
