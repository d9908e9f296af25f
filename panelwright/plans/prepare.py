"""The whole preparation: label, clean and transform with a written table after each stage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from panelwright.functions.levels import LEVEL_CUTS
from panelwright.operators.roles import Roles, best_roles, detect_roles
from panelwright.plans.clean import clean
from panelwright.plans.label import load_syntax
from panelwright.plans.transform import transform
from panelwright.sinks.writers import STAGES, read_stage, stage_root, write_stage
from panelwright.sources.files import route_files
from panelwright.sources.tables import read_csv


class Thresholds(NamedTuple):
    missing: float = 1.0
    uniform: float = 1.0
    correlation: float = 1.0


def clean_stage(
    spark: SparkSession, root: str, tables: Sequence[str], thresholds: Thresholds = Thresholds(), given: Roles = Roles()
) -> list[str]:
    """``labeled`` to ``cleaned``; returns the tables written."""
    for name in tables:
        df = read_stage(spark, root, "labeled", name)
        roles = detect_roles(df, given)
        ids = [r for r in (roles.student, roles.school) if r]
        result = clean(
            df, ids, thresholds.missing, thresholds.uniform, thresholds.correlation, roles.score,
        )
        write_stage(result.table, root, "cleaned", name)
    return list(tables)


def transform_stage(
    spark: SparkSession,
    root: str,
    tables: Sequence[str],
    given: Roles = Roles(),
    split_ranges: Sequence[tuple[int, int]] | None = None,
    cuts: Sequence[tuple[float, str]] = LEVEL_CUTS,
) -> list[str]:
    """``cleaned`` to ``leveled``; returns the tables written."""
    frames = {name: read_stage(spark, root, "cleaned", name) for name in tables}
    roles = best_roles(frames, given)
    if roles.score is None:
        return []
    ids = [r for r in (roles.student, roles.school) if r]
    done = transform(frames, roles.score, ids, split_ranges, cuts)
    for name, df in done.items():
        write_stage(df, root, "leveled", name)
    return list(done)


def prepare(
    spark: SparkSession,
    root: str,
    labeled: Mapping[str, DataFrame],
    thresholds: Thresholds = Thresholds(),
    given: Roles = Roles(),
    split_ranges: Sequence[tuple[int, int]] | None = None,
    cuts: Sequence[tuple[float, str]] = LEVEL_CUTS,
) -> list[str]:
    """Write the labeled tables, clean them, transform them; stops at an empty stage.

    Each stage starts from the table the stage before has written to the shared
    folder, so a lost executor costs at most the current stage's tasks.
    """
    if not labeled:
        return []
    for name, df in labeled.items():
        write_stage(df, root, "labeled", name)
    cleaned = clean_stage(spark, root, list(labeled), thresholds, given)
    return transform_stage(spark, root, cleaned, given, split_ranges, cuts)


class Labeled(NamedTuple):
    tables: dict[str, DataFrame]
    raw: dict[str, DataFrame]
    failed: dict[str, str]


class RawFile(NamedTuple):
    table: str
    path: str
    kind: str


def raw_files(spark: SparkSession, root: str) -> list[RawFile]:
    """The known files below a folder in order of their paths, stage folders left out, and the table each would give."""
    found = []
    base = root.removeprefix("file:").rstrip("/") + "/"
    for row in route_files(spark, root).orderBy("path").collect():
        path, kind = row["path"], row["format"]
        folder, _, file = path.rpartition("/")
        below = path[path.find(base) + len(base):] if base in path else file
        if folder.rpartition("/")[2] not in STAGES and kind != "skip":
            found.append(RawFile(below.rpartition(".")[0], path, kind))
    return found


def label_file(
    spark: SparkSession, file: RawFile, country: str | None = None, multi_line: bool = True
) -> tuple[DataFrame, DataFrame | None]:
    """(labeled, raw) tables of one file; a CSV file has no raw one."""
    if file.kind == "syntax":
        return load_syntax(spark, file.path, file.path.rpartition("/")[0], country)
    if file.kind == "csv":
        return read_csv(spark, file.path, multi_line=multi_line), None
    raise ValueError("binary survey files need a table and a codebook")


def label_folder(spark: SparkSession, root: str, country: str | None = None, multi_line: bool = True) -> Labeled:
    """Labeled tables of all known files below a folder, by path below it without the extension.

    Syntax files bring the fixed-width text they name, CSV files count as labeled.
    A file that cannot be planned is reported and does not stop the others; so is a
    file whose name another one has taken. Faults inside the data show when the
    table is written. ``multi_line=False`` splits large CSV files whose fields hold
    no line breaks.
    """
    done = Labeled({}, {}, {})
    for file in raw_files(spark, root):
        if file.table in done.tables:
            done.failed[file.path] = f"another file has given the table {file.table}"
            continue
        try:
            labeled, raw = label_file(spark, file, country, multi_line)
        except Exception as error:  # one bad file must not stop the run
            done.failed[file.path] = str(error)
            continue
        done.tables[file.table] = labeled
        if raw is not None:
            done.raw[file.table] = raw
    return done


def prepare_folder(
    spark: SparkSession,
    root: str,
    country: str | None = None,
    thresholds: Thresholds = Thresholds(),
    given: Roles = Roles(),
    split_ranges: Sequence[tuple[int, int]] | None = None,
    save_unlabeled: bool = False,
    multi_line: bool = True,
) -> tuple[list[str], dict[str, str]]:
    """Label, clean and transform all files below a folder; returns (tables written, failures)."""
    labeled = label_folder(spark, root, country, multi_line)
    target = stage_root(root)
    if save_unlabeled:
        for name, df in labeled.raw.items():
            write_stage(df, target, "labeled", f"{name}_unlabeled")
    return prepare(spark, target, labeled.tables, thresholds, given, split_ranges), labeled.failed
