"""Weighted merge of rankings and selections into one ordered attribute list per context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.positions import top_per_group, with_row_number
from panelwright.session import written_once

# Weight of the mean ranking, then of each selection filter.
WEIGHTS = (0.25, 0.30, 0.45)
TOP_N = 20
# Scores are compared at this many decimals, so equal means stay tied whatever the order of the sum.
TIE_DECIMALS = 10

CONTEXT = "result_name"


def mean_rankings(rankings: DataFrame) -> DataFrame:
    """``(result_name, attribute, mean_score, low_id, high_id, files)``.

    Scores are divided by the best score of their file; inside a file the last line
    of an attribute counts. The lines are aggregated to (file, attribute) first and
    written: the best scores and the means both start from that table, so the text
    is parsed once.
    """
    per_file = written_once(rankings.groupBy(CONTEXT, "file", "attribute").agg(
        F.max_by("score", "line_no").alias("score"), F.max("score").alias("high_score"),
        F.min("number").alias("low"), F.max("number").alias("high"),
    ), "file-scores")
    best = per_file.groupBy(CONTEXT, "file").agg(F.max("high_score").alias("best"))
    share = F.coalesce(F.try_divide("score", "best"), F.lit(0.0))
    return per_file.join(best, [CONTEXT, "file"]).groupBy(CONTEXT, "attribute").agg(
        F.avg(share).alias("mean_score"),
        F.min("low").alias("low_id"), F.max("high").alias("high_id"),
        F.count(F.lit(1)).alias("files"),
    )


def with_attribute_ids(means: DataFrame) -> DataFrame:
    """Add ``attribute_id``: the parsed number when all files of the context agree on every
    attribute, else the attribute's place in name order.

    The means are written once, because they are looked at before they are used;
    names are sorted for the differing contexts only.
    """
    means = written_once(means, "means")
    parsed = F.col("low_id").cast("int")
    differing = means.filter(F.col("low_id") != F.col("high_id")).select(CONTEXT).distinct()
    if differing.isEmpty():
        return means.withColumn("attribute_id", parsed)
    agreeing = means.join(differing, CONTEXT, "left_anti").withColumn("attribute_id", parsed)
    others = with_row_number(means.join(differing, CONTEXT, "left_semi"), [CONTEXT], [F.col("attribute")], "attribute_id")
    return agreeing.unionByName(others.withColumn("attribute_id", F.col("attribute_id").cast("int")))


def _weight(weights: Sequence[float], filter_idx: int) -> float:
    return float(weights[min(filter_idx + 1, len(weights) - 1)])


def ensemble_scores(
    means: DataFrame, selections: DataFrame, filters: int, weights: Sequence[float] = WEIGHTS
) -> DataFrame:
    """Add ``score`` = mean x first weight + the weight of every filter that selected the attribute.

    One row per selected attribute with a flag per filter, so the join has unique
    keys on both sides and the weights are added in a fixed order.
    """
    flags = [F.bool_or(F.col("filter_idx") == k).alias(f"__f{k}") for k in range(filters)]
    score = F.col("mean_score") * F.lit(float(weights[0]))
    if not flags:
        return means.withColumn("score", score)
    chosen = selections.groupBy(CONTEXT, "attribute").agg(*flags)
    for k in range(filters):
        score = score + F.when(F.col(f"__f{k}"), F.lit(_weight(weights, k))).otherwise(F.lit(0.0))
    joined = means.join(chosen, [CONTEXT, "attribute"], "left").withColumn("score", score)
    return joined.drop(*[f"__f{k}" for k in range(filters)])


def best_first() -> list[Column]:
    """Order of the final list: score descending, ties by attribute name."""
    return [F.desc("__order"), F.col("attribute")]


def _with_order(scores: DataFrame) -> DataFrame:
    return scores.withColumn("__order", F.round("score", TIE_DECIMALS))


def full_ranking(scores: DataFrame) -> DataFrame:
    """Every attribute with its ``rank`` inside the context."""
    ranked = with_row_number(_with_order(scores), [CONTEXT], best_first(), "rank").drop("__order")
    return ranked.withColumn("rank", F.col("rank").cast("int"))


def top_ranking(scores: DataFrame, n: int = TOP_N) -> DataFrame:
    """The best ``n`` attributes of each context with their ``rank``."""
    return top_per_group(_with_order(scores), [CONTEXT], best_first(), n, "rank").drop("__order")


def summary_table(ranking: DataFrame, n: int = TOP_N) -> DataFrame:
    """``(result_name, Rank, Score, Attribute_ID, Attribute_Name)`` of the first ``n`` ranks."""
    return ranking.filter(F.col("rank") <= n).select(
        CONTEXT,
        F.col("rank").alias("Rank"), F.round("score", 4).alias("Score"),
        F.col("attribute_id").alias("Attribute_ID"), F.col("attribute").alias("Attribute_Name"),
    )


def top_attributes(summary: DataFrame) -> DataFrame:
    """``(Dataset, Top Attribute)``, one row per context."""
    return summary.filter(F.col("Rank") == 1).select(
        F.col(CONTEXT).alias("Dataset"), F.col("Attribute_Name").alias("Top Attribute")
    )
