"""Text output of feature rankers and feature selectors as tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.text import WHITESPACE, array_from, strip
from panelwright.session import written_once
from panelwright.sources.splits import apply_states, split_lines, split_states, split_summaries

# --- fixed values: formats of the output text ----------------------------------
RANKING_LINE = r"-?[\d.]+\s+\d+\s+.+"
SELECTION_START = "Selected attributes:"
RANKING_FILTERS = ("CORR", "GAIN", "RELIEFF")
SELECTION_FILTERS = ("subset", "wrapper")
# ----------------------------------------------------------------------------


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def name_of_file(path: Column) -> Column:
    """The plain name of a file from its address, in which odd characters are escaped."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))


def ranking_method(file_name: Column, filters: Sequence[str] = RANKING_FILTERS) -> Column:
    """The first ranking filter that ends the file name, with or without extension."""
    name = F.upper(file_name)
    ends = [F.when(name.endswith(f.upper()) | _stem(name).endswith(f.upper()), f) for f in filters]
    return F.coalesce(*ends) if ends else F.lit(None).cast("string")


def contexts_of(file_name: Column, contexts: Sequence[str]) -> Column:
    """Array of the contexts named in the file name."""
    name = F.lower(file_name)
    hits = [F.when(name.contains(c.lower()), F.lit(c)) for c in contexts]
    return F.array_compact(F.array(*hits))


def selection_indexes(file_name: Column, filters: Sequence[str] = SELECTION_FILTERS) -> Column:
    """Array of the places of the selection filters named in the file name."""
    name = F.lower(file_name)
    hits = [F.when(name.contains(f.lower()), F.lit(k)) for k, f in enumerate(filters)]
    return F.array_compact(F.array(*hits))


def parse_ranking_lines(
    lines: DataFrame, line: str = "line", strict_reference: bool = False, rejected: bool = False
) -> DataFrame:
    """Lines of the form ``score number name``: adds ``score, number, attribute``.

    Works line by line, so a large file is read by many tasks. A minus sign counts;
    ``strict_reference`` drops it. Text that only looks like a score is no match;
    ``rejected`` returns these lines instead of the parsed ones.
    """
    keep = [c for c in lines.columns if c != line]
    # The outer form keeps Spark from testing the match array once more before it is exploded.
    found = F.explode_outer(F.regexp_extract_all(F.col(line), F.lit(RANKING_LINE), F.lit(0)))
    matches = lines.select(*keep, found.alias("__match")).filter(F.col("__match").isNotNull())
    parts = F.split("__match", r"\s+", 3)
    text = F.ltrim(parts[0], F.lit("-")) if strict_reference else parts[0]
    parsed = matches.select(
        *keep, text.try_cast("double").alias("score"), parts[1].try_cast("bigint").alias("number"), strip(parts[2]).alias("attribute")
    )
    whole = F.col("score").isNotNull() & F.col("number").isNotNull() & (F.col("attribute") != "")
    return parsed.filter(~whole if rejected else whole)


def rejected_ranking_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines of the ranking form whose score, number or name does not parse, to be counted or looked at."""
    return parse_ranking_lines(lines, line, rejected=True)


def normalise_scores(rankings: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Add ``norm_score`` = score / best score of its file; a best score of 0 gives 0.

    The best scores come from a partial aggregate joined back, not from a window:
    one file may hold a large part of all lines.
    """
    best = rankings.groupBy(*keys).agg(F.max("score").alias("__best"))
    ratio = F.coalesce(F.try_divide("score", "__best"), F.lit(0.0))
    return rankings.join(best, list(keys)).withColumn("norm_score", ratio).drop("__best")


def parse_selection_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``Selected attributes:`` blocks: adds ``block, place, attribute, attribute_id``.

    A block reaches to the first empty line. The numbers of its first line are the
    ids of the names on the following lines; a name without a number has id 0.
    """
    plain = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n")
    pieces = array_from(F.split(plain, SELECTION_START), 2)
    keep = [c for c in texts.columns if c != text]
    blocks = texts.select(*keep, F.posexplode(pieces).alias("block", "__piece"))
    lines = F.split(F.element_at(F.split("__piece", "\n\n", 2), 1), "\n")
    opened = blocks.select(*keep, "block", lines.alias("__lines")).select(
        *keep, "block",
        F.regexp_extract_all(F.col("__lines")[0], F.lit(r"\d+"), 0).alias("__ids"),
        F.filter(F.transform(array_from("__lines", 2), strip), lambda n: n != "").alias("__names"),
    )
    named = opened.select(*keep, "block", "__ids", F.posexplode_outer("__names").alias("place", "attribute")).filter(
        F.col("attribute").isNotNull()
    )
    attribute_id = F.coalesce(F.get("__ids", F.col("place")).try_cast("bigint"), F.lit(0))
    return named.select(*keep, "block", "place", "attribute", attribute_id.alias("attribute_id"))


def _named_files(spark: SparkSession, folder: str, contexts: Sequence[str], **facts: Column) -> tuple[DataFrame, list[str]]:
    """``(path, file, contexts, ...)`` of the files that have a context and all ``facts`` of their ``file``, and their paths.

    What a file name says is found once per file; a line only carries the path.
    """
    path = F.col("_metadata.file_path")
    files = spark.read.format("binaryFile").load(folder).select(path.alias("path")).distinct()
    named = files.withColumn("file", name_of_file(F.col("path"))).select(
        "path", "file", contexts_of(F.col("file"), contexts).alias("__contexts"), *[c.alias(k) for k, c in facts.items()])
    known = F.size("__contexts") > 0
    for fact, kind in named.dtypes[3:]:
        known = known & (F.size(fact) > 0 if kind.startswith("array") else F.col(fact).isNotNull())
    wanted = named.filter(known)
    rows = wanted.collect()
    return spark.createDataFrame(rows, wanted.schema), [r["path"] for r in rows]


def read_rankings(
    spark: SparkSession,
    folder: str,
    contexts: Sequence[str],
    filters: Sequence[str] = RANKING_FILTERS,
    strict_reference: bool = False,
) -> DataFrame:
    """``(result_name, file, method, line_no, score, number, attribute)``.

    The file name conditions prune files before they are opened. ``line_no`` orders
    the lines of a file (start of the split, then place in the split).
    """
    files, paths = _named_files(spark, folder, contexts, method=ranking_method(F.col("file"), filters))
    path = F.col("_metadata.file_path")
    lines = spark.read.text(folder).filter(path.isin(paths)).select(
        path.alias("path"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line_no"),
        F.col("value").alias("line"))
    scored = parse_ranking_lines(lines, "line", strict_reference).join(F.broadcast(files), "path")
    columns = ["file", "method", "line_no", "score", "number", "attribute"]
    return scored.select(F.explode("__contexts").alias("result_name"), *columns)


class InBlock(NamedTuple):
    """Where a line of selector output stands: blocks opened so far, whether one is open, names of the last one."""

    blocks: int = 0
    open: bool = False
    names: int = 0


class _BlockLines:
    """Walks selector lines; the first line of a block has no place, its names are numbered from 0."""

    def __init__(self, state: InBlock):
        self.blocks, self.open, self.names = state
        self.head = (self.open, self.names)  # as the lines before the first mark leave it

    def walk(self, lines: pa.Array) -> list[tuple[int, int | None, str]]:
        found: list[tuple[int, int | None, str]] = []
        for line in lines.to_pylist():
            if not self.open and SELECTION_START.encode() not in line:
                continue
            rest, *opened = line.decode("utf-8", "replace").split(SELECTION_START)
            if self.open:
                name = rest.strip(WHITESPACE)
                if name:
                    found.append((self.blocks - 1, self.names, name))
                    self.names += 1
                elif not rest and not opened:
                    self.open = False
            if not self.blocks:
                self.head = (self.open, self.names)
            for first_line in opened:
                self.blocks, self.open, self.names = self.blocks + 1, True, 0
                found.append((self.blocks - 1, None, first_line))
        return found


class _BlockSummary(_BlockLines):
    """What a split does when it starts inside a block."""

    def __init__(self):
        super().__init__(InBlock(0, True, 0))

    def add(self, lines: pa.Array) -> None:
        self.walk(lines)

    def row(self) -> tuple:
        return (self.blocks, *self.head, self.open, self.names)


class _BlockRows(_BlockLines):
    def add(self, lines: pa.Array) -> Iterator[list[pa.Array]]:
        found = self.walk(lines)
        if found:
            yield [pa.array(c, kind) for c, kind in zip(zip(*found), (pa.int32(), pa.int32(), pa.string()))]

    def finish(self) -> Iterator[list[pa.Array]]:
        return iter(())


class SelectionScan:
    """Blocks of selector output over the splits of a file: ``(block, place, text)``."""

    summary_schema = "blocks int, head_open boolean, head_names int, end_open boolean, names int"
    row_schema = "block int, place int, text string"

    def first(self) -> InBlock:
        return InBlock()

    def summary(self) -> _BlockSummary:
        return _BlockSummary()

    def after(self, state: InBlock, start: int, row: tuple) -> InBlock:
        blocks, head_open, head_names, end_open, names = row
        if blocks:
            return InBlock(state.blocks + blocks, end_open, names)
        return InBlock(state.blocks, head_open, state.names + head_names) if state.open else state

    def applier(self, start: int, state: InBlock) -> _BlockRows:
        return _BlockRows(state)


def selection_rows(lines: DataFrame) -> DataFrame:
    """``(file, block, place, attribute, attribute_id)`` of the lines of selector files, whatever splits they come in.

    Blocks and names are numbered over the splits; the ids of a block's first line then meet its names by
    place, so neither a file nor a block is ever one value. The numbered lines are written once, because the ids
    and the names both start from them.
    """
    scan = SelectionScan()
    rows = written_once(apply_states(lines, scan, split_states(split_summaries(lines, scan), scan)), "selection-lines")
    ids = rows.filter("place IS NULL").select(
        "file", "block", F.posexplode(F.regexp_extract_all("text", F.lit(r"\d+"), 0)).alias("place", "number"))
    names = rows.filter("place IS NOT NULL")
    return names.join(ids, ["file", "block", "place"], "left").select(
        "file", "block", "place", F.col("text").alias("attribute"),
        F.coalesce(F.col("number").try_cast("bigint"), F.lit(0)).alias("attribute_id"))


def read_selections(
    spark: SparkSession,
    folder: str,
    contexts: Sequence[str],
    filters: Sequence[str] = SELECTION_FILTERS,
) -> DataFrame:
    """``(result_name, file, filter, filter_idx, block, place, attribute, attribute_id)``.

    The file name conditions prune files before they are opened; a large file is read by many tasks.
    """
    files, paths = _named_files(spark, folder, contexts, __indexes=selection_indexes(F.col("file"), filters))
    found = selection_rows(split_lines(spark, folder).filter(F.col("file").isin(paths)))
    named = found.withColumnRenamed("file", "path").join(F.broadcast(files), "path")
    placed = named.withColumn("result_name", F.explode("__contexts"))
    indexed = placed.withColumn("filter_idx", F.explode("__indexes"))
    filter_name = F.get(F.array(*[F.lit(f) for f in filters]), F.col("filter_idx"))
    return indexed.select(
        "result_name", "file", filter_name.alias("filter"), "filter_idx", "block", "place", "attribute", "attribute_id"
    )
