"""Tables laid out by country, so that a scan of one country opens the files of that country only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.names import column
from panelwright.functions.text import equals_code

FOLDER = "country_key"
COUNTRY_COLUMN = "CNT"


def write_by_country(
    df: DataFrame, path: str, country: str = COUNTRY_COLUMN, look_ups: Sequence[str] = (), mode: str = "errorifexists"
) -> str:
    """One folder per upper-cased country, for a column of at most some hundred values.

    Rows are dealt by country and then evened out while running (rebalance): a country with much of the rows is
    written by several tasks, small ones share a task. ``look_ups`` names columns that get a Parquet bloom filter,
    so that a search for single values of them skips row groups. Missing and empty countries share a folder.
    """
    if FOLDER in df.columns:
        raise ValueError(f"the table has a column {FOLDER}")
    if missing := [c for c in (country, *look_ups) if c not in df.columns]:
        raise ValueError(f"the table has no columns {missing}")
    keyed = df.withColumn(FOLDER, F.upper(column(country).cast("string")))
    writer = keyed.hint("rebalance", F.col(FOLDER)).write.mode(mode).partitionBy(FOLDER)
    for c in look_ups:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)
    return path


def scan_country(spark: SparkSession, path: str, code: str | None, country: str = COUNTRY_COLUMN) -> DataFrame:
    """Rows of one country of a table from :func:`write_by_country`, ignoring case; an empty code keeps all rows.

    The folders decide which files are opened. Their names are read as text, so that a code such as ``040`` stays
    one. The column itself is compared too, because folder names cannot tell an empty country from a missing one.
    """
    found = spark.read.parquet(path).schema
    text = T.StructType([T.StructField(f.name, T.StringType()) if f.name == FOLDER else f for f in found.fields])
    rows = spark.read.schema(text).parquet(path)
    if code:
        rows = rows.filter(F.col(FOLDER) == F.upper(F.lit(code))).filter(equals_code(column(country), code))
    return rows.drop(FOLDER)
