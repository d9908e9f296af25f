"""Similarity of names to a fixed list of column names."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: lowest similarity ratio (2 x matched / total length) that counts as a match.
CUTOFF = 0.96


def _letters(name: Column) -> Column:
    """The characters of a name in order, repeats included."""
    return F.array_sort(F.filter(F.split(name, ""), lambda c: c != ""))


def _numbered(letters: Column) -> Column:
    """Each character with its number among its equals, so that sets of them are bags of characters."""
    return F.transform(letters, lambda c, k: F.concat(c, F.lit("#"), (k + 1 - F.array_position(letters, c)).cast("string")))


def _allowance(length: int, cutoff: float) -> int:
    """Characters without a partner in a pair of the cutoff's ratio, if one name has this length and the other fits it."""
    longest = length * (2 - cutoff) / cutoff
    return int((1 - cutoff) * (length + longest) + 1e-9)


def _parted(rows: DataFrame, letters: str) -> DataFrame:
    """``rows`` once per group of the alphabet, with the characters of the name that lie in it.

    There is one group more than characters without a partner, so two names that are close enough agree in a group.
    """
    grouped = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("allowance"))))
    inside = F.filter(letters, lambda c: F.pmod(F.ascii(c), F.col("allowance") + 1) == F.col("group"))
    return grouped.withColumn("part", F.array_join(inside, ""))


@F.pandas_udf(T.DoubleType())
def matching_ratio(names: pd.Series, columns: pd.Series) -> pd.Series:
    """Share of characters in matching blocks, of pairs that the bags of characters have let through."""
    return pd.Series([SequenceMatcher(None, c, n).ratio() for n, c in zip(names, columns)], dtype="float64")


def close_pairs(names: DataFrame, candidates: Sequence[str], cutoff: float = CUTOFF) -> DataFrame:
    """``(name, candidate)``: pairs whose bags of characters allow a ratio of the cutoff; ``names`` is ``(name)``, distinct.

    Names meet candidates in a join on parts of their characters, never each with each. How many characters may lack
    a partner follows from the candidate's length, so a name asks only for the lengths that fit its own.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("the cutoff lies above 0 and is 1 at most")
    listed = [c for c in dict.fromkeys(candidates) if c]
    lengths: dict[int, list[int]] = {}
    for c in listed:
        lengths.setdefault(_allowance(len(c), cutoff), []).append(len(c))
    if not listed:
        return names.select("name", F.col("name").alias("candidate")).limit(0)
    own = names.select("name", F.char_length("name").alias("length"), _letters(F.col("name")).alias("letters"))
    asked = F.array(*[
        F.struct(F.lit(allowance).alias("allowance"), F.lit(min(found) * cutoff / (2 - cutoff) - 1e-9).alias("least"),
                 F.lit(max(found) * (2 - cutoff) / cutoff + 1e-9).alias("most"))
        for allowance, found in sorted(lengths.items())
    ])
    fitting = own.withColumn("asked", F.explode(asked)).filter("length BETWEEN asked.least AND asked.most")
    left = _parted(fitting.select("name", "length", "letters", "asked.allowance"), "letters")
    offered = names.sparkSession.createDataFrame(
        [(c, len(c), _allowance(len(c), cutoff)) for c in listed], "candidate string, width int, allowance int")
    right = _parted(offered.select("*", _letters(F.col("candidate")).alias("theirs")), "theirs")
    partners = F.size(F.array_intersect(_numbered(F.col("letters")), _numbered(F.col("theirs"))))
    enough = 2.0 * partners / (F.col("length") + F.col("width")) >= cutoff
    # Lengths are compared first: they decide most pairs.
    near = 2.0 * F.least("length", "width") / (F.col("length") + F.col("width")) >= cutoff
    return left.join(right, ["allowance", "group", "part"]).filter(near).filter(enough).select("name", "candidate").distinct()


def closest_columns(names: DataFrame, candidates: Sequence[str], cutoff: float = CUTOFF) -> DataFrame:
    """``(name, closest)``: the closest candidate of each distinct ``name`` that has one within the cutoff.

    The candidates are a table's header, so their number is bounded by the schema; the names are rows and stay
    distributed. Of equal ratios the greatest candidate wins. A missing or empty name is close to nothing.
    """
    scored = close_pairs(names, candidates, cutoff).withColumn("ratio", matching_ratio("name", "candidate"))
    return scored.filter(F.col("ratio") >= cutoff).groupBy("name").agg(
        F.max(F.struct("ratio", "candidate")).alias("best")).select("name", F.col("best.candidate").alias("closest"))
