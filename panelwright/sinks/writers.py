"""CSV, stage and result writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.names import column, rename_all
from panelwright.functions.text import CP1252_BYTES, CP1252_CHARACTERS, to_cp1252, year_of_name
from panelwright.operators.columns import map_columns, select_required
from panelwright.operators.moments import text_columns

STAGES = ("labeled", "cleaned", "leveled")


def _as_cp1252(df: DataFrame, errors: str) -> DataFrame:
    """Values and names in the Latin-1 spelling of code page 1252; a character without a byte is an error or ``?``."""
    table = str.maketrans(CP1252_CHARACTERS, CP1252_BYTES)
    names = [n.translate(table) for n in df.columns]
    unknown = [n for n, new in zip(df.columns, names) if max(new, default=" ") > "\xff"]
    if unknown and errors == "strict":
        raise ValueError(f"column names outside code page 1252: {unknown}")

    def checked(c: Column) -> Column:
        text = to_cp1252(c)
        fault = F.raise_error(F.concat(F.lit("text outside code page 1252: "), c))
        return F.when(text.rlike(r"[^\x00-\xff]"), fault).otherwise(text) if errors == "strict" else text

    return rename_all(map_columns(df, text_columns(df), checked), names)


def write_csv(df: DataFrame, path: str, encoding: str = "utf-8", errors: str = "strict") -> str:
    """CSV folder with header, every field quoted, quotes doubled, NULL as an empty field.

    In code page 1252 a character that it lacks is an error; ``errors="replace"`` writes ``?`` instead.
    """
    if encoding.lower() == "cp1252":
        df, encoding = _as_cp1252(df, errors), "iso-8859-1"
    (
        df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"')
        .option("emptyValue", "").option("nullValue", "").option("encoding", encoding).csv(path)
    )
    return path


def nan_marked(df: DataFrame) -> DataFrame:
    """All columns as text with ``nan`` for missing, the form attribute-selection tools read."""
    return df.select(*[F.coalesce(column(c).cast("string"), F.lit("nan")).alias(c) for c in df.columns])


def write_csv_nan_marked(df: DataFrame, path: str) -> str:
    return write_csv(nan_marked(df), path)


def stage_root(folder: str) -> str:
    """The folder that holds the stage folders: the parent when the input is in a stage."""
    folder = folder.rstrip("/")
    head, _, last = folder.rpartition("/")
    return head if last in STAGES else folder


def stage_path(root: str, stage: str, table: str) -> str:
    return f"{root.rstrip('/')}/{stage}/{table}"


def write_stage(df: DataFrame, root: str, stage: str, table: str, csv: bool = False) -> str:
    """Write one table of a stage; Parquet by default, CSV on request."""
    path = stage_path(root, stage, table)
    if csv:
        return write_csv(df, path)
    df.write.mode("overwrite").parquet(path)
    return path


def read_stage(spark: SparkSession, root: str, stage: str, table: str) -> DataFrame:
    return spark.read.parquet(stage_path(root, stage, table))


def write_results(
    summaries: Mapping[str, DataFrame], subsets: Mapping[str, DataFrame], root: str, csv: bool = False
) -> dict[str, str]:
    """``Rank_<context>`` and ``Data_<context>`` tables; a context without columns has no data table."""
    written = {}
    for context, summary in summaries.items():
        tables = {f"Rank_{context}": summary}
        if context in subsets and subsets[context].columns:
            tables[f"Data_{context}"] = subsets[context]
        for name, df in tables.items():
            path = f"{root.rstrip('/')}/{name}"
            if csv:
                write_csv(df, path)
            else:
                df.write.mode("overwrite").parquet(path)
            written[name] = path
    return written


def write_top_by_year(
    overall: DataFrame, dataset: DataFrame, root: str, top: int, dataset_name: str | None,
    ids: Sequence[str], scores: Sequence[str], year: str | None = None,
) -> dict[str, str]:
    """First rows of the overall summary and an id + score projection, one folder per year."""
    subset = select_required(dataset, [*ids, *scores])
    label = F.lit(year) if year else year_of_name(F.lit(dataset_name).cast("string"))
    key = "Rank" if "Rank" in overall.columns else overall.columns[0]
    head = overall.orderBy(column(key)).limit(top)
    paths = {"top": f"{root}/Top_{top}", "ids": f"{root}/IDs_Math"}
    for name, df in (("top", head), ("ids", subset)):
        df.withColumn("year", label).write.mode("overwrite").partitionBy("year").parquet(paths[name])
    return paths
