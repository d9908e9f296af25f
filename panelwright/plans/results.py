"""Process model output: rankings and selections to a top list and a reduced data set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.names import (
    attribute_column,
    clean_attribute_headers,
    clean_attribute_name,
)
from panelwright.operators import ranking
from panelwright.operators.columns import select_existing
from panelwright.operators.matching import match_names
from panelwright.operators.roles import essential_columns
from panelwright.session import written_once
from panelwright.sinks.writers import write_results
from panelwright.sources.model_output import (
    RANKING_FILTERS,
    SELECTION_FILTERS,
    read_rankings,
    read_selections,
)


class Results(NamedTuple):
    scores: DataFrame               # result_name, attribute, attribute_id, mean_score, score, ...
    summary: DataFrame              # result_name, Rank, Score, Attribute_ID, Attribute_Name
    overall: DataFrame              # Dataset, Top Attribute
    subsets: dict[str, DataFrame]   # reduced data set per context


def score_attributes(
    rankings: DataFrame, selections: DataFrame, filters: int, weights: Sequence[float] = ranking.WEIGHTS
) -> DataFrame:
    """Final score of every attribute of every context, all contexts in one job."""
    means = ranking.with_attribute_ids(ranking.mean_rankings(rankings))
    return ranking.ensemble_scores(means, selections, filters, weights)


def selected_names(summary: DataFrame) -> dict[str, list[str]]:
    """Top attribute names per context in rank order; top-N rows only reach the driver."""
    names: dict[str, list[str]] = {}
    for row in summary.select(ranking.CONTEXT, "Rank", "Attribute_Name").orderBy(ranking.CONTEXT, "Rank").collect():
        names.setdefault(row[ranking.CONTEXT], []).append(row["Attribute_Name"])
    return names


def reduce_dataset(dataset: DataFrame, selected: Sequence[str], essentials: Sequence[str] = ()) -> DataFrame:
    """Selected and essential columns that exist, in rank order, each once."""
    cleaned = clean_attribute_headers(dataset)
    return select_existing(cleaned, [*selected, *[clean_attribute_name(e) for e in essentials]])


def context_of_path(path: str) -> str:
    """Context name of a data set file: its base name without the extension."""
    return path.rstrip("/").rpartition("/")[2].rpartition(".")[0] or path.rstrip("/").rpartition("/")[2]


def process_results(
    spark: SparkSession,
    folder: str,
    dataset: DataFrame,
    contexts: Sequence[str],
    essentials: Mapping[str, Sequence[str]] | None = None,
    ranking_filters: Sequence[str] = RANKING_FILTERS,
    selection_filters: Sequence[str] = SELECTION_FILTERS,
    weights: Sequence[float] = ranking.WEIGHTS,
    top: int = ranking.TOP_N,
) -> Results:
    """Rank the attributes found in a folder of model output and reduce the data set to the best."""
    rankings = read_rankings(spark, folder, contexts, ranking_filters)
    selections = read_selections(spark, folder, contexts, selection_filters)
    return merge_results(rankings, selections, dataset, len(selection_filters), essentials, weights, top)


def merge_results(
    rankings: DataFrame,
    selections: DataFrame,
    dataset: DataFrame,
    filters: int,
    essentials: Mapping[str, Sequence[str]] | None = None,
    weights: Sequence[float] = ranking.WEIGHTS,
    top: int = ranking.TOP_N,
) -> Results:
    scores = score_attributes(rankings, selections, filters, weights)
    # Written once: its names are looked at here, and its rows are read again.
    summary = written_once(ranking.summary_table(ranking.top_ranking(scores, top), top), "summary")
    subsets = {
        context: reduce_dataset(dataset, names, (essentials or {}).get(context, ()))
        for context, names in selected_names(summary).items()
    }
    return Results(scores, summary, ranking.top_attributes(summary), subsets)


def mapped_summary(summary: DataFrame, dataset: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Summary rows with the data set column each attribute stands for."""
    attributes = [c for c in summary.columns if c != ranking.CONTEXT]
    return match_names(summary, attribute_column(attributes), dataset.columns, fuzzy)


def save_top_selection(
    summary: DataFrame,
    dataset: DataFrame,
    root: str,
    top: int = ranking.TOP_N,
    ids: Sequence[str] | None = None,
    csv: bool = False,
) -> dict[str, str]:
    """Write per context the mapped summary and the data set reduced to mapped + essential columns."""
    dataset = clean_attribute_headers(dataset)
    # Written once, then split by context.
    mapped = written_once(mapped_summary(summary.filter(F.col("Rank") <= top), dataset), "mapped")
    kept = essential_columns(dataset, ids)
    rows = mapped.select(ranking.CONTEXT, "Rank", "mapped_dataset_column").orderBy(ranking.CONTEXT, "Rank").collect()
    columns: dict[str, list[str]] = {}
    for row in rows:
        columns.setdefault(row[ranking.CONTEXT], []).append(row["mapped_dataset_column"])
    summaries, subsets = {}, {}
    for context, names in columns.items():
        summaries[context] = mapped.filter(F.col(ranking.CONTEXT) == context).drop(ranking.CONTEXT)
        subsets[context] = select_existing(dataset, [*[n for n in names if n], *kept])
    return write_results(summaries, subsets, root, csv)
