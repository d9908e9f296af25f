"""The whole preparation of a folder, redoing only what has changed since the last run.

Each stage table has a record beside the stages: what it was made from, and a token that its making has got. A labeled
table is made from files (path, length, time) and parameters; a later table from the tokens of the tables before it and
parameters. A table whose record still holds is left alone. A record is removed before its table is written again and
put back after, so a run that was lost at any point goes on where it stopped.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from typing import Any, NamedTuple
from urllib.parse import unquote

from pyspark.sql import SparkSession

from panelwright.functions.levels import LEVEL_CUTS
from panelwright.operators.roles import Roles
from panelwright.plans.label import write_labeled
from panelwright.plans.prepare import RawFile, Thresholds, clean_stage, label_file, raw_files, transform_stage
from panelwright.sinks.versions import file_state, put_if_absent, read_text, remove
from panelwright.sinks.writers import stage_path, stage_root

# Raised when the rules of a stage change, so that tables of older rules are made anew.
RULES = 1


class Prepared(NamedTuple):
    tables: list[str]  # leveled tables that hold now
    written: list[str]  # stage/table of all that this run has written
    failed: dict[str, str]


class _Records:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.written: list[str] = []

    def _path(self, stage: str, table: str) -> str:
        return f"{self.root}/records/{stage}/{table}.json"

    def read(self, stage: str, table: str) -> dict[str, Any] | None:
        """The record of a table that was written whole and is still there."""
        text = read_text(self.spark, self._path(stage, table))
        record = json.loads(text) if text is not None else None
        if record and all(file_state(self.spark, f"{stage_path(self.root, stage, t)}/_SUCCESS") for t in record["tables"]):
            return record
        return None

    def kept(self, stage: str, table: str, source: dict[str, Any]) -> dict[str, Any] | None:
        record = self.read(stage, table)
        return record if record and record["source"] == json.loads(json.dumps(source)) else None

    def make(self, stage: str, table: str, source: dict[str, Any], write: Callable[[], Sequence[str]]) -> dict[str, Any]:
        """Write tables and their record; a second writer of the same folder gets ``FileExistsError``."""
        path = self._path(stage, table)
        remove(self.spark, path)
        record = {"source": source, "token": uuid.uuid4().hex, "tables": list(write())}
        put_if_absent(self.spark, path, json.dumps(record))
        self.written += [f"{stage}/{t}" for t in record["tables"]]
        return record


def _data_paths(syntax: str, files: Sequence[str]) -> list[str]:
    """The data file beside a syntax file, or the folder that holds its parts: new parts count as a change."""
    here = syntax.rpartition("/")[0].partition(":")[2].lstrip("/")
    paths = set()
    for uri in files:
        path = unquote(uri)
        folder = path.rpartition("/")[0]
        paths.add(path if folder.partition(":")[2].lstrip("/") == here else folder)
    return sorted(paths)


def _labeled(records: _Records, file: RawFile, country: str | None, save_unlabeled: bool, multi_line: bool) -> dict[str, Any]:
    spark = records.spark
    rules = {"rules": RULES, "path": file.path, "kind": file.kind, "country": country, "raw": save_unlabeled, "multi_line": multi_line}
    record = records.read("labeled", file.table)
    if record:
        # A syntax file that has not changed still names the same data file.
        states = {path: file_state(spark, path) for path in record["source"]["files"]}
        if record["source"] == {**rules, "files": states}:
            return record
    # The states are taken before the files are read: a later change shows in the next run.
    labeled, raw = label_file(spark, file, country, multi_line)
    paths = [file.path, *_data_paths(file.path, raw.inputFiles() if raw is not None else ())]
    source = {**rules, "files": {path: file_state(spark, path) for path in paths}}

    def write() -> list[str]:
        unlabeled = save_unlabeled and raw is not None
        write_labeled(labeled, raw, records.root, file.table, unlabeled)
        return [file.table, *([f"{file.table}_unlabeled"] if unlabeled else [])]

    return records.make("labeled", file.table, source, write)


def prepare_changed(
    spark: SparkSession,
    root: str,
    country: str | None = None,
    thresholds: Thresholds = Thresholds(),
    given: Roles = Roles(),
    split_ranges: Sequence[tuple[int, int]] | None = None,
    cuts: Sequence[tuple[float, str]] = LEVEL_CUTS,
    save_unlabeled: bool = False,
    multi_line: bool = True,
) -> Prepared:
    """As ``prepare_folder``, but only what is new, changed or lost is written.

    A file that fails is reported and tried again in the next run. Tables of files that are gone stay on disk and are
    no longer used. The success marks that Spark writes tell whole tables, so they must not be switched off.
    """
    records = _Records(spark, stage_root(root))
    failed: dict[str, str] = {}
    cleaned: dict[str, str] = {}
    for file in raw_files(spark, root):
        if file.table in cleaned:
            failed[file.path] = f"another file has given the table {file.table}"
            continue
        try:
            labeled = _labeled(records, file, country, save_unlabeled, multi_line)
        except FileExistsError:
            raise
        except Exception as error:  # one bad file must not stop the run
            failed[file.path] = str(error)
            continue
        source = {"rules": RULES, "labeled": labeled["token"], "thresholds": list(thresholds), "given": list(given)}
        done = records.kept("cleaned", file.table, source) or records.make(
            "cleaned", file.table, source, lambda name=file.table: clean_stage(spark, records.root, [name], thresholds, given))
        cleaned[file.table] = done["token"]
    if not cleaned:
        return Prepared([], records.written, failed)
    source = {"rules": RULES, "cleaned": cleaned, "given": list(given), "ranges": split_ranges, "cuts": list(cuts)}
    leveled = records.kept("leveled", "all", source) or records.make(
        "leveled", "all", source, lambda: transform_stage(spark, records.root, list(cleaned), given, split_ranges, cuts))
    return Prepared(leveled["tables"], records.written, failed)
