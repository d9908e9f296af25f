"""CSV whose quoted fields may hold line breaks, read by many tasks per file.

A line that starts inside or outside quotes ends inside or outside them, and that is all a split has to pass on. Records that
lie in several splits are put together from their pieces. The rules are those of the usual reader: a field is quoted when its
first character is a quote, a doubled quote stands for one, and quotes inside an unquoted field are plain characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.sources.splits import apply_states, split_lines, split_states, split_summaries

# --- fixed values: the CSV grammar, for lines without their break ----------------
TAIL = r'(?:[^",][^,]*)?'
FIELD = rf'(?:"(?:[^"]|"")*"{TAIL}|[^",][^,]*|)'
CLOSED_FROM_OUTSIDE = rf"^{FIELD}(?:,{FIELD})*$"
CLOSED_FROM_INSIDE = rf'^(?:[^"]|"")*"{TAIL}(?:,{FIELD})*$'
# ----------------------------------------------------------------------------


def quote_ends(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line ends inside quotes, if it starts outside, and if it starts inside."""
    outside, inside = np.zeros(len(lines), bool), np.ones(len(lines), bool)
    quoted = pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)
    if quoted.any():
        some = lines.filter(pa.array(quoted))
        for ends, pattern in ((outside, CLOSED_FROM_OUTSIDE), (inside, CLOSED_FROM_INSIDE)):
            ends[quoted] = ~pc.match_substring_regex(some, pattern).to_numpy(zero_copy_only=False)
    return outside, inside


def running_state(outside: np.ndarray, inside: np.ndarray, start: bool) -> np.ndarray:
    """State behind each line: a line keeps the state, turns it, or sets it; turns since the last set decide."""
    fixed, turns = outside == inside, np.cumsum(outside & ~inside)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(fixed)), -1))
    base = np.where(last >= 0, outside[last], start)
    return base ^ ((turns - np.where(last >= 0, turns[last], 0)) & 1).astype(bool)


class _Ends:
    """Per start state of a split: its end state, and whether a record ends in it."""

    def __init__(self):
        self.state, self.ended = [False, True], [False, False]

    def add(self, lines: pa.Array) -> None:
        ends = quote_ends(lines)
        for k in (0, 1):
            after = running_state(*ends, self.state[k])
            self.ended[k] |= not after.all()
            self.state[k] = bool(after[-1])

    def row(self) -> tuple:
        return (*self.state, *self.ended)


class _Records:
    """Records of a split; pieces of records that reach over its ends name the split in which the record opened."""

    def __init__(self, start: int, opener: int | None):
        self.start, self.opener, self.inside = start, opener, opener is not None
        self.pending: list[bytes] = []
        self.header = start == 0

    def _rows(self, records: list | pa.Array, opener: int | None, header: bool = False) -> list[pa.Array]:
        n = len(records)
        records = records if isinstance(records, pa.Array) else pa.array(records, pa.binary())
        return [pa.array([opener] * n, pa.int64()), pa.array([self.start] * n, pa.int64()), pa.array([header] * n, pa.bool_()), records]

    def add(self, lines: pa.Array) -> Iterator[list[pa.Array]]:
        after = running_state(*quote_ends(lines), self.inside)
        self.inside = bool(after[-1])
        if not after.any() and not self.pending and self.opener is None and not self.header:
            yield self._rows(lines, None)
            return
        ends = np.flatnonzero(~after)
        texts, records, at = lines.to_pylist(), [], 0
        for end in ends.tolist():
            record = b"\n".join([*self.pending, *texts[at : end + 1]])
            self.pending, at = [], end + 1
            if self.opener is not None:
                yield self._rows([record], self.opener)
                self.opener = None
            elif self.header:
                self.header = False
            else:
                records.append(record)
        self.pending += texts[at:]
        if records:
            yield self._rows(records, None)

    def finish(self) -> Iterator[list[pa.Array]]:
        if self.pending:
            opener = self.start if self.opener is None else self.opener
            yield self._rows([b"\n".join(self.pending)], opener, self.header and self.opener is None)


class QuoteScan:
    """The state is the start of the split in which the open record began, or None outside quotes."""

    summary_schema = "end_outside boolean, end_inside boolean, ended_outside boolean, ended_inside boolean"
    row_schema = "opener long, start long, header boolean, record binary"

    def first(self) -> int | None:
        return None

    def summary(self) -> _Ends:
        return _Ends()

    def after(self, state: int | None, start: int, row: tuple) -> int | None:
        inside = state is not None
        if not row[inside]:
            return None
        return state if inside and not row[2 + inside] else start

    def applier(self, start: int, state: int | None) -> _Records:
        return _Records(start, state)


def quoted_records(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """``(file, record binary)``: the records of CSV files, a header line at the start of each file left out.

    A first scan finds which splits start inside quotes. Where none does, a second one cuts all records; otherwise the
    few splits whose ends lie inside a record are read once more for its pieces.
    """
    scan, lines = QuoteScan(), split_lines(spark, path, "\n")
    states = split_states(split_summaries(lines, scan), scan)
    whole = apply_states(lines, scan, states).filter("opener IS NULL").select("file", "record")
    cut = [(file, start) for (file, start), ends in states.items() if ends != (None, None)]
    if cut:
        places = F.broadcast(spark.createDataFrame(cut, "file string, start long"))
        pieces = apply_states(lines.join(places, ["file", "start"], "left_semi"), scan, states).filter("opener IS NOT NULL")
        # A header that fills the first split leaves a piece that says so.
        joined = pieces.groupBy("file", "opener").agg(
            F.sort_array(F.collect_list(F.struct("start", "record"))).alias("pieces"), F.bool_or("header").alias("header"))
        text = F.concat_ws("\n", F.transform("pieces", lambda p: F.decode(p["record"], "ISO-8859-1")))
        whole = whole.unionByName(joined.filter(~F.col("header")).select("file", F.encode(text, "ISO-8859-1").alias("record")))
    trimmed = F.when(F.endswith(F.col("record"), F.lit(b"\r")), F.expr("substring(record, 1, octet_length(record) - 1)")).otherwise(F.col("record"))
    return whole.select("file", trimmed.alias("record")).filter(F.octet_length("record") > 0)


def parsed_records(records: DataFrame, names: list[str], charset: str) -> DataFrame:
    """The fields of CSV records as text columns, extra fields left out, lacking ones NULL."""
    schema = ", ".join(f"c{k} string" for k in range(len(names)))
    fields = F.from_csv(F.decode("record", charset), F.lit(schema), {"escape": '"', "multiLine": "true"})
    split = records.select(fields.alias("f"))
    return split.select(*[F.col(f"f.c{k}").alias(name) for k, name in enumerate(names)])
