"""File discovery by listing, and the first bytes of files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------
IGNORED_FOLDERS = (
    "results", "resultados", "__pycache__", ".git", ".backups", "$recycle.bin",
    "system volume information",
)
EXTENSIONS = (".csv", ".sav", ".txt", ".sps", ".spss")
SYNTAX_EXTENSIONS = (".sps", ".spss")
SYNTAX_MARKS = ("DATA LIST", "VARIABLE LABELS")
# A text file counts as syntax when a mark occurs in this many first characters.
SNIFF_CHARACTERS = 2048
# ----------------------------------------------------------------------------


def has_extension(path: Column, extensions: Sequence[str] = EXTENSIONS) -> Column:
    low = F.lower(path)
    hit = F.lit(False)
    for extension in extensions:
        hit = hit | low.endswith(extension)
    return hit


def in_ignored_folder(path: Column, ignored: Sequence[str] = IGNORED_FOLDERS) -> Column:
    """True when a folder on the path, or the entry itself, has an ignored name."""
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*[F.lit(i) for i in ignored]))


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """``(path, length, modificationTime)`` of all files; the content column is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return reader.load(root).select("path", "length", "modificationTime")


def wanted_paths(
    files: DataFrame, extensions: Sequence[str] = EXTENSIONS, ignored: Sequence[str] = IGNORED_FOLDERS
) -> DataFrame:
    """Distinct paths with a known extension outside the ignored folders, sorted."""
    kept = files.filter(has_extension(F.col("path"), extensions) & ~in_ignored_folder(F.col("path"), ignored))
    return kept.select("path").distinct().orderBy("path")


def discover(
    spark: SparkSession,
    root: str,
    extensions: Sequence[str] = EXTENSIONS,
    ignored: Sequence[str] = IGNORED_FOLDERS,
    recursive: bool = True,
) -> DataFrame:
    return wanted_paths(listing(spark, root, recursive), extensions, ignored)


def scan_level(spark: SparkSession, root: str) -> DataFrame:
    """``(kind, name)`` one level below the root: known files, and folders that hold files."""
    base = F.regexp_extract("path", r"^.*?" + _escaped(root.rstrip("/")) + r"/(.*)$", 1)
    below = listing(spark, root).select(F.split(base, "/").alias("parts"))
    first = F.col("parts")[0]
    kind = F.when(F.size("parts") > 1, "folder").otherwise("file")
    entries = below.select(kind.alias("kind"), first.alias("name")).distinct()
    known = (F.col("kind") == "folder") | has_extension(F.col("name"))
    return entries.filter(known & ~in_ignored_folder(F.col("name"))).orderBy("kind", "name")


def _escaped(literal: str) -> str:
    import re

    return re.escape(literal.removeprefix("file:"))


def looks_like_syntax(text: Column, characters: int = SNIFF_CHARACTERS) -> Column:
    head = F.upper(F.substring(text, 1, characters))
    hit = F.lit(False)
    for mark in SYNTAX_MARKS:
        hit = hit | head.contains(mark)
    return hit


def file_format(path: Column, text: Column | None = None) -> Column:
    """``syntax``, ``skip`` (other text), ``csv`` or ``table`` by extension and sniffed text."""
    sniffed = looks_like_syntax(text) if text is not None else F.lit(False)
    return (
        F.when(has_extension(path, SYNTAX_EXTENSIONS), "syntax")
        .when(has_extension(path, (".txt",)), F.when(sniffed, "syntax").otherwise("skip"))
        .when(has_extension(path, (".csv",)), "csv")
        .otherwise("table")
    )


def file_heads(paths: DataFrame, characters: int = SNIFF_CHARACTERS, path: str = "path") -> DataFrame:
    """``(path, head)``: the first characters of each file, decoded from UTF-8, odd bytes replaced.

    Tasks open the listed files themselves and read the first bytes only, so the size of a file does not count;
    the paths are dealt over the tasks. The file systems must be ones that pyarrow reaches.
    """
    size = 4 * characters  # a character has at most four bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for uri in batch.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(full_uri(uri))
                with system.open_input_stream(name, compression=None, buffer_size=None) as source:
                    heads.append(source.read(size).decode("utf-8", "replace")[:characters])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.string())], names=["path", "head"])

    tasks = paths.sparkSession.sparkContext.defaultParallelism
    return paths.select(F.col(path).alias("path")).repartition(tasks, "path").mapInArrow(run, "path string, head string")


def full_uri(path: str) -> str:
    """A listed path, which is not escaped, as an address; local ones come as ``file:/name``."""
    scheme, _, rest = path.rpartition("://") if "://" in path else ("file", "", path.removeprefix("file:"))
    return f"{scheme}://{quote(rest)}"


def route_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, format)`` of all known files; of ``.txt`` files the first characters are read."""
    paths = discover(spark, root)
    texts = file_heads(paths.filter(has_extension(F.col("path"), (".txt",))))
    sniffed = texts.select(F.col("path").alias("__path"), looks_like_syntax(F.col("head")).alias("__syntax"))
    routed = paths.join(sniffed, F.col("path") == F.col("__path"), "left")
    kind = F.when(F.col("__syntax"), "syntax").otherwise(file_format(F.col("path")))
    return routed.select("path", kind.alias("format"))
