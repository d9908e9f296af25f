"""Attribute names of model output matched to the columns of a data set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.names import clean_attribute_name, column
from panelwright.functions.similarity import CUTOFF, closest_columns
from panelwright.functions.text import clean_attribute


def match_names(
    names: DataFrame, attribute: str, columns: Sequence[str], fuzzy: bool = True, cutoff: float = CUTOFF
) -> DataFrame:
    """Add ``mapped_dataset_column`` and ``match_type`` (exact, fuzzy, none) to the rows.

    Each distinct name is matched once. The column list is a header and stays on the
    executors as a literal; names that are not in it meet the columns that share enough
    of their characters, and only such pairs are scored.
    """
    known = list(dict.fromkeys(clean_attribute_name(c) for c in columns))
    distinct = names.select(column(attribute).alias("__name")).distinct()
    cleaned = distinct.withColumn("__clean", clean_attribute(F.col("__name")))
    exact = F.col("__clean").isin(known) & (F.col("__clean") != "")
    marked = cleaned.withColumn("__exact", F.coalesce(exact, F.lit(False)))
    if fuzzy:
        open_names = marked.filter(~F.col("__exact") & (F.col("__clean") != "")).select(F.col("__clean").alias("name")).distinct()
        guesses = closest_columns(open_names, known, cutoff).select(F.col("name").alias("__clean"), F.col("closest").alias("__guess"))
        guessed = marked.join(guesses, "__clean", "left")
    else:
        guessed = marked.withColumn("__guess", F.lit(None).cast("string"))
    matched = guessed.select(
        "__name",
        F.when(F.col("__exact"), F.col("__clean")).otherwise(F.col("__guess")).alias("mapped_dataset_column"),
        F.when(F.col("__exact"), "exact").when(F.col("__guess").isNotNull(), "fuzzy").otherwise("none").alias("match_type"),
    )
    joined = names.join(matched, column(attribute).eqNullSafe(F.col("__name")), "left")
    return joined.select(*[column(c) for c in names.columns], "mapped_dataset_column", "match_type")
