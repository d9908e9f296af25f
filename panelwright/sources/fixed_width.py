"""Fixed-width text cut into columns by a codebook layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.text import fixed_width_field, from_cp1252, starts_with_code
from panelwright.sources.codebook import Layout


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a code page 1252 text file as ``line``; large files are split over tasks."""
    raw = F.col("value").cast("binary")
    return spark.read.text(path).select(from_cp1252(F.decode(raw, "ISO-8859-1")).alias("line"))


def cut_lines(lines: DataFrame, layout: Layout, country: str | None = None, line: str = "line") -> DataFrame:
    """One text column per field; lines of other countries are skipped before they are cut."""
    kept = lines.filter(starts_with_code(F.col(line), country))
    fields = zip(layout.names, layout.starts, layout.ends)
    return kept.select(*[fixed_width_field(F.col(line), s, e).alias(n) for n, s, e in fields])


def read_fixed_width(spark: SparkSession, path: str, layout: Layout, country: str | None = None) -> DataFrame:
    return cut_lines(read_lines(spark, path), layout, country)
