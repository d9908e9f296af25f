"""Names, Spark functions and reference SQL of the driver queries."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
# Rows of a narrow table that one task turns into texts or lines.
ROWS_PER_TASK = 100_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """The rows dealt to as many tasks as their number asks for: a narrow table is stored so densely that one split
    of its file may hold millions of rows, each of which becomes a text or several lines."""
    tasks = math.ceil(df.count() / rows)
    return df.repartition(tasks, *df.columns) if tasks > 1 else df


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def named_files(spark: SparkSession, folder: str, root: str, name: Callable[[str, int], str]) -> list[str]:
    """Move the part files that Spark wrote below a folder: ``name(sub-folder, number)`` gives the path below the root."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    source = hadoop.Path(folder)
    system = source.getFileSystem(spark._jsc.hadoopConfiguration())
    files = system.listFiles(source, True)
    parts = []
    while files.hasNext():
        path = files.next().getPath()
        if path.getName().startswith("part-"):
            parts.append(path)
    moved = []
    for number, path in enumerate(sorted(parts, key=lambda p: p.toString())):
        inner = path.getParent().getName() if path.getParent().getName() != source.getName() else ""
        target = hadoop.Path(root.rstrip("/") + "/" + name(inner, number))
        system.mkdirs(target.getParent())
        if not system.rename(path, target):
            raise OSError(f"{path} could not be moved to {target}")
        moved.append(target.toString())
    return moved
