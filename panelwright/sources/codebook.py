"""Syntax files (column layout, labels, missing codes) as codebook tables.

Files are read by splits: a small state, carried from one split to the next, tells the place of a line in
the value label sections. Texts that are rows already are cut inside their row. Only the final "last
definition wins" aggregates shuffle codebook rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.text import CP1252_BYTES, CP1252_CHARACTERS, WHITESPACE, array_from, from_cp1252, strip_once
from panelwright.operators.labels import listed_code_key
from panelwright.session import written_once
from panelwright.sources.splits import apply_states, split_lines, split_states, split_summaries

# --- fixed values: format of the syntax text --------------------------------------
COLUMN_PATTERN = r"^(\w+)\s+(\d+)\s+-\s+(\d+)\s+(\(A\)|\(F,\d+\))"
DATA_FILE_PATTERN = r"(?i)DATA LIST FILE\s+\"([^\"]+)\""
MISSING_START = "Missing values"
LABELS_START = "value labels"
SKIPPED_LINES = 2
MISSING_LABEL = "Missing"
# ------------------------------------------------------------------------------


class Codebook(NamedTuple):
    data_files: DataFrame     # file, data_file
    variables: DataFrame      # file, ordinal, name, start, end, fmt, label
    value_labels: DataFrame   # file, name, code, label
    missing_codes: DataFrame  # file, name, code


def read_syntax(spark: SparkSession, path: str) -> DataFrame:
    """``(file, text)``; code page 1252 bytes are decoded by way of ISO-8859-1."""
    raw = F.col("value").cast("binary")
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), from_cp1252(F.decode(raw, "ISO-8859-1")).alias("text")
    )


def _texts(files: DataFrame) -> DataFrame:
    """``(file, text)``: a line break, then the lines after the skipped ones without leading blanks."""
    blanks = "[" + "".join(re.escape(c) for c in WHITESPACE if c not in "\r\n") + "]+"
    lines = F.regexp_replace(F.concat(F.lit("\n"), "text"), "\r\n?", "\n")
    trimmed = F.regexp_replace(lines, f"\n{blanks}", "\n")
    skipped = r"\A(?:\n[^\n]*){%d}" % SKIPPED_LINES
    return files.select("file", F.regexp_replace(trimmed, skipped, "").alias("text"))


def _variables(numbered: DataFrame) -> DataFrame:
    found = numbered.filter(F.col("line").rlike(COLUMN_PATTERN)).select(
        "file", "line_no",
        *[F.regexp_extract("line", COLUMN_PATTERN, k).alias(p) for k, p in enumerate(("name", "start", "end", "fmt"), 1)],
    )
    latest = [F.max_by(p, "line_no").alias(p) for p in ("start", "end", "fmt")]
    return found.groupBy("file", F.upper("name").alias("name")).agg(F.min("line_no").alias("ordinal"), *latest).select(
        "file", "ordinal", "name", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "fmt"
    )


def _labels(numbered: DataFrame) -> DataFrame:
    """Text between the first two double quotes of a line belongs to the name before them."""
    parts = F.split("line", '"')
    found = numbered.filter(F.col("line").contains('"')).select(
        "file", "line_no", F.upper(strip_once(parts[0])).alias("name"), parts[1].alias("label")
    )
    return found.groupBy("file", "name").agg(F.max_by("label", "line_no").alias("label"))


def _missing(numbered: DataFrame) -> DataFrame:
    """Third word of the line is the variable, the last word a comma list of codes."""
    words = F.split(strip_once("line"), r"\s+")
    marked = numbered.filter(F.col("line").startswith(MISSING_START) & ~F.col("line").contains('"'))
    codes = F.explode(F.split(F.element_at(words, -1), ","))
    found = marked.filter(F.size(words) > 2).select("file", F.upper(words[2]).alias("name"), codes.alias("code"))
    return found.select("file", "name", listed_code_key(F.btrim(strip_once("code"), F.lit("()."))).alias("code")).distinct()


def _value_labels(texts: DataFrame) -> DataFrame:
    """``code label`` lines between a line ``value labels`` and a line that starts with ``.``.

    A line that starts with a single slash names the variables of the lines after
    it, also over section ends. The text is cut at these marks with ``split``, so the
    state of a reader walking the lines is never needed.
    """
    sections = array_from(F.split("text", f"\n{LABELS_START}"), 2)
    # Each piece: rest of the opening line, the section, and whatever follows its closing line.
    bodies = F.transform(sections, lambda s: F.regexp_replace(F.split(s, r"\n\.", 2)[0], r"^[^\n]*", ""))
    groups = array_from(F.split(F.array_join(bodies, ""), r"\n/(?!/)"), 2)
    cut = texts.select("file", F.posexplode_outer(groups).alias("group_no", "group")).select(
        "file", "group_no", F.split("group", "\n").alias("rows")
    )
    return _entries(cut.select(
        "file", "group_no", F.col("rows")[0].alias("head"), F.posexplode_outer(array_from("rows", 2)).alias("row_no", "row")
    ), F.struct("group_no", "row_no"))


def _entries(rows: DataFrame, place: Column) -> DataFrame:
    """The last label of each code from ``(file, head, row)``: ``head`` holds the variables behind a slash."""
    names = F.split(F.upper(strip_once(F.split("head", "/")[0])), r"\s+")
    entries = rows.withColumn("row", strip_once("row")).filter(F.col("row").contains(" "))
    pair = F.split("row", " ", 2)
    found = entries.select(
        "file", place.alias("place"), F.explode(names).alias("name"),
        listed_code_key(pair[0]).alias("code"), strip_once(F.translate(pair[1], "\"'", "")).alias("label"),
    )
    return found.groupBy("file", "name", "code").agg(F.max_by("label", "place").alias("label"))


def parse_codebook(files: DataFrame) -> Codebook:
    """Codebook tables of ``(file, text)`` syntax files, all files in one job each."""
    texts = _texts(files)
    numbered = texts.select("file", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    named = F.regexp_extract("text", DATA_FILE_PATTERN, 1)
    return _codebook(files.select("file", _base_name(named).alias("data_file")), numbered, _value_labels(texts))


def _base_name(path: Column) -> Column:
    """Last part of a path with backslashes; NULL for none."""
    return F.nullif(F.element_at(F.split(path, r"\\"), -1), F.lit(""))


def _codebook(data_files: DataFrame, numbered: DataFrame, value_labels: DataFrame) -> Codebook:
    variables = _variables(numbered)
    keys = variables.select("file", "name")
    return Codebook(
        data_files,
        variables.join(_labels(numbered), ["file", "name"], "left").select(
            "file", "ordinal", "name", "start", "end", "fmt", "label"
        ),
        value_labels.join(keys, ["file", "name"]).select("file", "name", "code", "label"),
        _missing(numbered).join(keys, ["file", "name"]).select("file", "name", "code"),
    )


BLANKS = "".join(c for c in WHITESPACE if c not in "\r\n")
LATIN_TO_CP1252 = str.maketrans(CP1252_BYTES, CP1252_CHARACTERS)
DATA_FILE_HERE = re.compile(DATA_FILE_PATTERN)
DATA_FILE_BELOW = re.compile(r"(?i)DATA LIST FILE\s*$")
NAME_ALONE = re.compile(r'\s*"([^"]+)"')


class InSyntax(NamedTuple):
    """Where a line of a syntax file stands: lines before it, inside a value label section or not, the text that names the
    variables of the entries, and whether the data file's name is still to come."""

    lines: int = 0
    section: bool = False
    names: str | None = None
    waiting: bool = False


class _SyntaxLines:
    def __init__(self, state: InSyntax):
        self.lines, self.section, self.names, self.waiting = state

    def step(self, line: bytes) -> tuple[str | None, str | None, str | None]:
        """The line without leading blanks, the names it is an entry of, the data file it names; a skipped line can only name
        the data file."""
        self.lines += 1
        text = line.decode("latin-1").translate(LATIN_TO_CP1252).lstrip(BLANKS)
        data_file = DATA_FILE_HERE.search(text) or (NAME_ALONE.match(text) if self.waiting else None)
        self.waiting = bool(DATA_FILE_BELOW.search(text)) or self.waiting and not text.strip()
        if self.lines <= SKIPPED_LINES:
            return None, None, data_file[1] if data_file else None
        names = None
        if text.startswith(LABELS_START):
            self.section = True
        elif text.startswith("."):
            self.section = False
        elif self.section and text.startswith("/") and not text.startswith("//"):
            self.names = text[1:]
        elif self.section:
            names = self.names
        return text, names, data_file[1] if data_file else None


class _SyntaxSummary:
    """A split's first lines as they are, which may be among those that are skipped, and what the others do: before their
    first section mark, if they start inside a section, and from it on."""

    def __init__(self):
        self.head: list[bytes] = []
        self.inside = _SyntaxLines(InSyntax(SKIPPED_LINES, True))
        self.marked, self.blank, self.names_before = False, True, None

    def add(self, lines: pa.Array) -> None:
        texts = lines.to_pylist()
        missing = SKIPPED_LINES - len(self.head)
        self.head += texts[:missing]
        for line in texts[missing:] if missing else texts:
            text = self.inside.step(line)[0]
            self.blank = self.blank and not text.strip()
            if not self.marked:
                if text.startswith((LABELS_START, ".")):
                    self.marked, self.names_before, self.inside.names = True, self.inside.names, None
                else:
                    self.names_before = self.inside.names

    def row(self) -> tuple:
        after = self.inside
        names = after.names if self.marked else None
        return (self.head, after.lines - SKIPPED_LINES, self.marked, self.names_before, after.section, names, self.blank, after.waiting)


class _SyntaxRows(_SyntaxLines):
    def add(self, lines: pa.Array) -> Iterator[list[pa.Array]]:
        found = []
        for line in lines.to_pylist():
            row = self.step(line)
            if row[0] is not None or row[2] is not None:
                found.append((self.lines, *row))
        if found:
            yield [pa.array(c, kind) for c, kind in zip(zip(*found), (pa.int64(), pa.string(), pa.string(), pa.string()))]

    def finish(self) -> Iterator[list[pa.Array]]:
        return iter(())


class SyntaxScan:
    """Lines of syntax files over their splits: ``(line_no, line, head, data_file)``."""

    summary_schema = (
        "first_lines array<binary>, lines long, marked boolean, names_before string, section boolean, names string, "
        "blank boolean, waiting boolean"
    )
    row_schema = "line_no long, line string, head string, data_file string"

    def first(self) -> InSyntax:
        return InSyntax()

    def summary(self) -> _SyntaxSummary:
        return _SyntaxSummary()

    def after(self, state: InSyntax, start: int, row: tuple) -> InSyntax:
        first_lines, lines, marked, names_before, section, names, blank, waiting = row
        walk = _SyntaxLines(state)
        for line in first_lines:
            walk.step(bytes(line))
        if walk.section and names_before is not None:
            walk.names = names_before
        if marked:
            walk.section = section
            walk.names = walk.names if names is None else names
        return InSyntax(walk.lines + lines, walk.section, walk.names, walk.waiting if blank else waiting)

    def applier(self, start: int, state: InSyntax) -> _SyntaxRows:
        return _SyntaxRows(state)


def read_codebook(spark: SparkSession, path: str | list[str]) -> Codebook:
    """Codebook tables of syntax files on disk; a large file is read by many tasks."""
    scan, lines = SyntaxScan(), split_lines(spark, path)
    summaries = written_once(split_summaries(lines, scan), "syntax-splits")
    rows = written_once(apply_states(lines, scan, split_states(summaries, scan)), "syntax-lines")
    named = rows.filter("data_file IS NOT NULL").groupBy("file").agg(F.min_by("data_file", "line_no").alias("data_file"))
    files = summaries.select("file").distinct().join(named, "file", "left")
    entries = rows.filter("head IS NOT NULL").select("file", "line_no", "head", F.col("line").alias("row"))
    return _codebook(
        files.select("file", _base_name(F.col("data_file")).alias("data_file")), rows.select("file", "line_no", "line"),
        _entries(entries, F.col("line_no")))


def decode_table(codebook: Codebook) -> DataFrame:
    """``(file, name, code, label)`` with missing codes as ``Missing``; a value label wins."""
    missing = codebook.missing_codes.select("*", F.lit(MISSING_LABEL).alias("label"), F.lit(0).alias("order"))
    both = codebook.value_labels.withColumn("order", F.lit(1)).unionByName(missing)
    return both.groupBy("file", "name", "code").agg(F.max_by("label", "order").alias("label"))


class Layout(NamedTuple):
    """Fields of one fixed-width file in table order; bounded by its column count."""

    names: list[str]
    starts: list[int]
    ends: list[int]
    labels: list[str | None]


def layout_of(codebook: Codebook, file: str) -> Layout:
    rows = codebook.variables.filter(F.col("file") == file).orderBy("ordinal").collect()
    return Layout(*([r[k] for r in rows] for k in ("name", "start", "end", "label")))
