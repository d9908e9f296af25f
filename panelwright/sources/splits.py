"""Text files read split by split, with state that runs through a file.

What a line means may depend on the lines before it: an open quote, a section, a line number. Spark cuts large files into
splits, and each split is summed up on its own for every state it may start with. The summaries, one small row per split, are
put together in file order on the driver, and a second scan applies to each split the state found for its start. So a file of
any size is read by many tasks, and no file is one value. Both scans must see the same splits: the files must not change
between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = "file string, start long"


def split_lines(spark: SparkSession, path: str | list[str], line_end: str | None = None) -> DataFrame:
    """``(file, start, line binary)``: lines in order inside each split; without ``line_end`` all usual ends count."""
    reader = spark.read if line_end is None else spark.read.option("lineSep", line_end)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"))


class Summary(Protocol):
    """Sums up the lines of one split as they pass."""

    def add(self, lines: pa.Array) -> None: ...

    def row(self) -> tuple: ...


class Applier(Protocol):
    """Turns the lines of one split into rows, given the state at its start."""

    def add(self, lines: pa.Array) -> Iterator[list[pa.Array]]: ...

    def finish(self) -> Iterator[list[pa.Array]]: ...


class Scan(Protocol):
    """A fold over the lines of a file that can be cut anywhere."""

    summary_schema: str
    row_schema: str

    def first(self) -> Any:
        """The state at the start of a file."""

    def summary(self) -> Summary: ...

    def after(self, state: Any, start: int, row: tuple) -> Any:
        """The state behind a split, from that before it and the split's summary."""

    def applier(self, start: int, state: Any) -> Applier: ...


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """Neighbouring lines of one split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["file", "start"])
        codes = ends.column(1).to_numpy()
        names = ends.column(0).dictionary_encode().indices.to_numpy()
        cuts = [0, *(((codes[1:] != codes[:-1]) | (names[1:] != names[:-1])).nonzero()[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield (batch.column(0)[a].as_py(), int(codes[a])), batch.column(2).slice(a, b - a)


def _fields(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def split_summaries(lines: DataFrame, scan: Scan) -> DataFrame:
    """``(file, start, ...)``: one row per split that holds the start of a line."""
    schema = f"{PLACE}, {scan.summary_schema}"
    arrow = lines.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, summary = None, None
        for here, part in _runs(batches):
            if here != place:
                if place is not None:
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, (*place, *summary.row())))], schema=arrow)
                place, summary = here, scan.summary()
            summary.add(part)
        if place is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, (*place, *summary.row())))], schema=arrow)

    return lines.mapInArrow(run, schema)


def split_states(summaries: DataFrame, scan: Scan) -> dict[tuple[str, int], tuple[Any, Any]]:
    """State before and behind every split; as many entries as Spark has splits."""
    states: dict[tuple[str, int], tuple[Any, Any]] = {}
    file, state = None, None
    for row in sorted(summaries.collect(), key=lambda r: (r["file"], r["start"])):
        if row["file"] != file:
            file, state = row["file"], scan.first()
        behind = scan.after(state, row["start"], tuple(row)[2:])
        states[row["file"], row["start"]] = (state, behind)
        state = behind
    return states


def apply_states(lines: DataFrame, scan: Scan, states: dict[tuple[str, int], tuple[Any, Any]]) -> DataFrame:
    """``(file, ...)``: the rows a scan makes of the lines."""
    schema = f"file string, {scan.row_schema}"
    names = _fields(schema)
    shared = lines.sparkSession.sparkContext.broadcast({place: before for place, (before, _) in states.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(columns: Iterator[list[pa.Array]]) -> Iterator[pa.RecordBatch]:
            for found in columns:
                yield pa.RecordBatch.from_arrays([pa.repeat(place[0], len(found[0])), *found], names=names)

        place, applier = None, None
        for here, part in _runs(batches):
            if here != place:
                if place is not None:
                    yield from made(applier.finish())
                if here not in shared.value:
                    raise RuntimeError(f"{here[0]} was cut differently in the first scan, at {here[1]}")
                place, applier = here, scan.applier(here[1], shared.value[here])
            yield from made(applier.add(part))
        if place is not None:
            yield from made(applier.finish())

    return lines.mapInArrow(run, schema)
