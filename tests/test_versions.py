"""Versions of a table by manifest."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from panelwright.sinks import versions


def files_below(root):
    return sorted((str(p), p.stat().st_mtime_ns) for p in root.rglob("*.parquet"))


def test_drop_and_restore_move_no_data(spark, tmp_path):
    path = str(tmp_path / "table")
    assert versions.versions(spark, path) == [] and versions.unused_data(spark, path) == []
    assert versions.write_version(spark.createDataFrame([(1, 2, "x.y")], "a int, b int, `c.d` string"), path) == 0
    before = files_below(tmp_path)
    assert versions.drop_columns_versioned(spark, path, 0, ["b", "zz"]) == 1
    assert versions.drop_columns_versioned(spark, path, 1, ["c.d"]) == 2
    assert versions.read_version(spark, path, 1).columns == ["a", "c.d"]
    assert versions.read_version(spark, path, 2).collect() == [(1,)]
    assert versions.restore_version(spark, path, 0).collect() == [(1, 2, "x.y")]
    assert versions.commit_restored(spark, path, 0) == 3
    assert versions.read_version(spark, path, 3).columns == ["a", "b", "c.d"]
    assert versions.versions(spark, path) == [0, 1, 2, 3] and files_below(tmp_path) == before
    plan = versions.read_version(spark, path, 2)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:int>" in plan


def test_a_version_is_never_replaced(spark, tmp_path):
    path = str(tmp_path / "table")
    versions.write_version(spark.range(3), path)
    before = files_below(tmp_path)
    with pytest.raises(FileExistsError, match="exists"):
        versions.write_version(spark.range(1), path, 0)
    assert files_below(tmp_path) == before and versions.read_version(spark, path, 0).count() == 3
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path, 7)


def test_one_of_many_writers_wins(spark, tmp_path):
    path = str(tmp_path / "table")

    def write(k):
        try:
            versions.write_version(spark.range(k + 1), path, 0)
            return k
        except FileExistsError:
            return None

    with ThreadPoolExecutor(6) as pool:
        won = [k for k in pool.map(write, range(6)) if k is not None]
    assert len(won) == 1 and versions.read_version(spark, path, 0).count() == won[0] + 1
    assert versions.unused_data(spark, path) == []


def test_rename_does_not_overwrite(spark, tmp_path):
    (tmp_path / "a").write_text("new")
    (tmp_path / "c").write_text("newer")
    path = spark._jvm.org.apache.hadoop.fs.Path
    where = [path(f"file://{tmp_path}/{n}") for n in "abc"]
    versions._rename_new(spark, where[0], where[1])
    with pytest.raises(FileExistsError):
        versions._rename_new(spark, where[2], where[1])
    assert (tmp_path / "b").read_text() == "new" and (tmp_path / "c").exists() and not (tmp_path / "a").exists()


def test_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(Exception, match="(?i)spoiled"):
        versions.write_version(spark.range(1).selectExpr("raise_error('spoiled') AS a"), path)
    assert versions.versions(spark, path) == [] and versions.unused_data(spark, path) == []
