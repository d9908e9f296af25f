"""Training-data pipeline: quality rules, near copies, benchmark passages, secrets, token ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import bpe, decontamination, quality, secrets, simhash
from panelwright.llm.common import Stage
from panelwright.llm.queries import word_vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of documents, the number of characters counted anew."""
    return rows.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    return quality.keep_good(docs.select(*COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their benchmark passages."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    cleaned = decontamination.remove_spans(decontamination.contamination(docs.select(*COLUMNS), benchmark))
    return _documents(cleaned.select("row.doc_id", "text", "row.lang", "row.source"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return _documents(secrets.mask_secrets(docs.select(*COLUMNS)))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids and their decoded text."""
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), word_vocabulary())
    return coded.select("doc_id", "lang", "source", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("secret scans", secret_spans),
    ("BPE encoding and decoding", token_ids),
]
# SimHash groups and BPE are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = Stage(stage(spark, docs, sf_dir), name.replace(" ", "-")).read()
    return STAGES[-1][1](spark, docs, sf_dir)
