"""Versions of a table: small manifests over shared, immutable Parquet folders.

A version is a manifest that names a data folder and the columns that belong to it. Dropping or restoring columns
writes a manifest and moves no data. A manifest appears whole or not at all and is never replaced, so of two writers
of one version one wins and the other gets ``FileExistsError``; data without a manifest are never seen.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Sequence
from typing import Any, NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from panelwright.functions.names import column


class Manifest(NamedTuple):
    """What a version holds: a folder below the table, its schema, and the columns that are part of the version."""

    data: str
    schema: dict[str, Any]
    columns: list[str]


def _hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of a path and the path itself, with its scheme."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(where)


def _write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    system, where = _hadoop(spark, path)
    out = system.create(where, False)
    try:
        out.write(content)
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text, None where there is none."""
    system, where = _hadoop(spark, path)
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def file_state(spark: SparkSession, path: str) -> list[Any] | None:
    """Length and time of a file, the same of all files of a folder with a digest of their names; None where nothing is."""
    system, where = _hadoop(spark, path)
    if not system.exists(where):
        return None
    status = system.getFileStatus(where)
    if not status.isDirectory():
        return [status.getLen(), status.getModificationTime()]
    files = sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in system.listStatus(where))
    return [len(files), hashlib.sha256(json.dumps(files).encode()).hexdigest()]


def remove(spark: SparkSession, path: str) -> None:
    system, where = _hadoop(spark, path)
    system.delete(where, True)


def _rename_new(spark: SparkSession, source: Any, target: Any) -> None:
    """Rename a file unless the target exists, which the file system decides at one place."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.NONE
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(source, target, options)
    except Py4JJavaError as error:
        if context.util().exists(target):
            raise FileExistsError(f"{target.toString()} exists") from error
        raise


def put_if_absent(spark: SparkSession, path: str, content: str) -> None:
    """Write a small file whole, unless there is one: then ``FileExistsError``.

    The content is written beside it and renamed without overwriting. A local file system only looks before it
    renames, so there a hard link takes the rename's place.
    """
    system, target = _hadoop(spark, path)
    system.mkdirs(target.getParent())
    source = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    try:
        _write_bytes(spark, source.toString(), content.encode())
        if system.getUri().getScheme() == "file":
            os.link(source.toUri().getPath(), target.toUri().getPath())
        else:
            _rename_new(spark, source, target)
    finally:
        system.delete(source, False)


def _manifest_path(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/versions/{version:012d}.json"


def _commit(spark: SparkSession, path: str, version: int, manifest: Manifest) -> int:
    if version < 0:
        raise ValueError("versions count from 0")
    put_if_absent(spark, _manifest_path(path, version), json.dumps(manifest._asdict()))
    return version


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions of a table in order."""
    system, where = _hadoop(spark, f"{path.rstrip('/')}/versions")
    if not system.exists(where):
        return []
    names = (status.getPath().getName() for status in system.listStatus(where))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest_of(spark: SparkSession, path: str, version: int) -> Manifest:
    found = read_text(spark, _manifest_path(path, version))
    if found is None:
        raise FileNotFoundError(f"{path} has no version {version}")
    return Manifest(**json.loads(found))


def write_version(df: DataFrame, path: str, version: int = 0) -> int:
    """Write a table as an immutable version; an existing one is never overwritten.

    The data are written first. If another writer has committed the version meanwhile, they are removed again.
    """
    spark = df.sparkSession
    if read_text(spark, _manifest_path(path, version)) is not None:
        raise FileExistsError(f"{path} has a version {version}: it exists already")
    data = f"data/{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/{data}"
    try:
        df.write.mode("errorifexists").parquet(folder)
        return _commit(spark, path, version, Manifest(data, json.loads(df.schema.json()), df.columns))
    except (PySparkException, Py4JJavaError, OSError):
        remove(spark, folder)
        raise


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The columns of a version; others of the shared data are not read."""
    manifest = manifest_of(spark, path, version)
    rows = spark.read.schema(T.StructType.fromJson(manifest.schema)).parquet(f"{path.rstrip('/')}/{manifest.data}")
    return rows.select(*[column(c) for c in manifest.columns])


def drop_columns_versioned(spark: SparkSession, path: str, version: int, marks: Sequence[str]) -> int:
    """Commit version + 1 without the marked columns; the old version is the restore point. No data move."""
    manifest = manifest_of(spark, path, version)
    gone = set(marks)
    return _commit(spark, path, version + 1, manifest._replace(columns=[c for c in manifest.columns if c not in gone]))


def restore_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The table as it was before later drops."""
    return read_version(spark, path, version)


def commit_restored(spark: SparkSession, path: str, version: int) -> int:
    """Make an old version the latest one again, as a new version. No data move."""
    return _commit(spark, path, versions(spark, path)[-1] + 1, manifest_of(spark, path, version))


def unused_data(spark: SparkSession, path: str) -> list[str]:
    """Data folders that no version names: left by lost writers, or of writers that have not committed yet."""
    system, where = _hadoop(spark, f"{path.rstrip('/')}/data")
    if not system.exists(where):
        return []
    named = {manifest_of(spark, path, v).data for v in versions(spark, path)}
    return sorted(n for s in system.listStatus(where) if (n := f"data/{s.getPath().getName()}") not in named)
