"""CSV tables, single columns, headers and previews."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.names import column, rename_all
from panelwright.functions.text import CP1252_BYTES, CP1252_CHARACTERS, NA_TOKENS, equals_code, from_cp1252
from panelwright.operators.columns import na_tokens_as_null, nan_as_null, numbers_or_categories, map_columns
from panelwright.sources.files import discover, listing
from panelwright.sources.quoted_csv import parsed_records, quoted_records

COUNTRY_COLUMN = "CNT"
# Encodings in which quotes, commas and line breaks are single bytes that stand for nothing else.
BYTE_ENCODINGS = {"utf-8": "UTF-8", "us-ascii": "US-ASCII", "ascii": "US-ASCII", "iso-8859-1": "ISO-8859-1", "latin-1": "ISO-8859-1"}


def _is_cp1252(encoding: str) -> bool:
    return encoding.lower().replace("-", "").replace("_", "") in ("cp1252", "windows1252")


def _may_be_cut(spark: SparkSession, path: str) -> bool:
    """True when a file is so large that Spark may read it in several splits."""
    conf = spark._jsparkSession.sessionState().conf()
    never_cut = min(conf.filesOpenCostInBytes(), conf.filesMaxPartitionBytes())
    return not listing(spark, path, recursive=False).filter(F.col("length") > never_cut).isEmpty()


def _raw_csv(spark: SparkSession, path: str, encoding: str, multi_line: bool, rows: bool = True) -> DataFrame:
    """All columns as text. Code page 1252 is read as ISO-8859-1 and corrected, because
    Spark's reader does not know it; the first 128 and the last 96 characters agree.

    Spark's reader takes a file with line breaks in quotes in one task; a file that is large enough
    to be cut goes through :func:`quoted_records`, if ``rows`` are wanted and not only the header.
    """
    cp1252 = _is_cp1252(encoding)
    charset = "iso-8859-1" if cp1252 else encoding
    df = (
        spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
        .option("encoding", charset).csv(path)
    )
    if rows and multi_line and charset.lower() in BYTE_ENCODINGS and _may_be_cut(spark, path):
        df = parsed_records(quoted_records(spark, path), df.columns, BYTE_ENCODINGS[charset.lower()])
    if not cp1252:
        return df
    fixed = map_columns(df, df.columns, from_cp1252)
    table = str.maketrans(CP1252_BYTES, CP1252_CHARACTERS)
    return rename_all(fixed, [n.translate(table) for n in fixed.columns])


def read_csv(
    spark: SparkSession,
    path: str,
    encoding: str = "cp1252",
    na_tokens: Sequence[str] = NA_TOKENS,
    infer: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """CSV with header; missing tokens become NULL, columns of numbers become double.

    ``multi_line`` allows line breaks inside quotes; large files are split all the same, at
    the price of one more scan that finds the splits which start inside quotes (other encodings
    than those of ``BYTE_ENCODINGS`` and code page 1252 are read one file per task).
    Set it to False for files whose writer escapes line breaks, as the CSV sink of
    this package does after cleaning: that spares the scan.
    """
    df = na_tokens_as_null(_raw_csv(spark, path, encoding, multi_line), na_tokens)
    return numbers_or_categories(df)[0] if infer else df


def read_csv_folder(spark: SparkSession, folder: str, **options) -> dict[str, DataFrame]:
    """One table per CSV file of the folder (one level), in name order.

    Schemas differ from file to file, so every file is its own plan.
    """
    listed = discover(spark, folder, extensions=(".csv",), recursive=False)
    paths = [r["path"] for r in listed.select("path").orderBy("path").collect()]
    return {p.rsplit("/", 1)[-1]: read_csv(spark, p, **options) for p in paths}


def read_column(spark: SparkSession, path: str, name: str, **options) -> DataFrame | None:
    """One column of a CSV file; the reader parses only that column. None when unknown."""
    return pick_column(read_csv(spark, path, infer=False, **options), name)


def pick_column(df: DataFrame, name: str) -> DataFrame | None:
    return df.select(column(name)) if name in df.columns else None


def column_list(spark: SparkSession, path: str, encoding: str = "cp1252") -> list[str]:
    """Header of a CSV file, without reading its rows."""
    return _raw_csv(spark, path, encoding, multi_line=True, rows=False).columns


def preview(df: DataFrame, rows: int = 100) -> DataFrame:
    """The first rows of a table, for looking at it."""
    return df.limit(rows)


def read_parquet_tables(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """Named Parquet tables in the given order, with NaN as NULL."""
    return {name: nan_as_null(spark.read.parquet(path)) for name, path in paths.items()}


def rows_of_country(df: DataFrame, code: str | None, country: str = COUNTRY_COLUMN) -> DataFrame:
    """Rows of one country, ignoring case; an empty code keeps all rows."""
    return df.filter(equals_code(column(country), code)) if code else df
