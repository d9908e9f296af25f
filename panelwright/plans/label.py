"""Load and label: raw table or fixed-width text plus codebook to a labeled table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators.labels import decode_labels, label_headers
from panelwright.sinks.writers import write_stage
from panelwright.sources.codebook import Codebook, decode_table, layout_of, read_codebook
from panelwright.sources.fixed_width import read_fixed_width
from panelwright.sources.tables import COUNTRY_COLUMN, rows_of_country


def label_table(raw: DataFrame, codebook: Codebook, file: str) -> DataFrame:
    """Decode the values, then rename the variables to their labels."""
    codes = decode_table(codebook).filter(F.col("file") == file)
    variables = codebook.variables.filter(F.col("file") == file).select("name", "label").collect()
    return label_headers(decode_labels(raw, codes), [(v["name"], v["label"]) for v in variables])


def load_syntax(
    spark: SparkSession, syntax_path: str, data_folder: str, country: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(labeled, raw) tables of one syntax file and the fixed-width text it names."""
    codebook = read_codebook(spark, syntax_path)
    head = codebook.data_files.first()
    if head is None or head["data_file"] is None:
        raise ValueError(f"no data file named in {syntax_path}")
    layout = layout_of(codebook, head["file"])
    raw = read_fixed_width(spark, f"{data_folder.rstrip('/')}/{head['data_file']}", layout, country)
    return label_table(raw, codebook, head["file"]), raw


def load_table(
    raw: DataFrame, codebook: Codebook, file: str, country: str | None = None, country_column: str = COUNTRY_COLUMN
) -> tuple[DataFrame, DataFrame]:
    """(labeled, raw) rows of one country from a table and its codebook."""
    rows = rows_of_country(raw, country, country_column)
    return label_table(rows, codebook, file), rows


def write_labeled(labeled: DataFrame, raw: DataFrame, root: str, table: str, save_unlabeled: bool = False) -> str:
    path = write_stage(labeled, root, "labeled", table)
    if save_unlabeled:
        write_stage(raw, root, "labeled", f"{table}_unlabeled")
    return path
