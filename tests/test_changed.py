"""The preparation of a folder, redone only where something changed."""

import os

import pytest

from panelwright.plans import changed
from panelwright.plans.changed import prepare_changed
from panelwright.plans.prepare import Thresholds, prepare_folder

PV = "Plausible Value 1 in Mathematics"


def parts(root):
    return {str(p): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def later(path):
    """Files of one length within a clock tick must still differ in time."""
    os.utime(path, ns=(path.stat().st_atime_ns, path.stat().st_mtime_ns + 10**10))


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "a survey"
    folder.mkdir()
    (folder / "stu.csv").write_text(f"Intl. School ID,Intl. Student ID,{PV}\n" + "".join(f"{k % 3},{k},{300 + 7 * k}.5\n" for k in range(60)))
    (folder / "sch.csv").write_text("Intl. School ID,size\n0,10\n1,20\n2,30\n")
    (folder / "broken.sps").write_text("a\nb\n")
    return folder


def test_second_run_writes_nothing(spark, root):
    first = prepare_changed(spark, str(root))
    assert first.written == ["labeled/sch", "cleaned/sch", "labeled/stu", "cleaned/stu", *[f"leveled/{t}" for t in first.tables]]
    assert list(first.failed) and "full_merged" in first.tables
    before = parts(root)
    second = prepare_changed(spark, str(root))
    assert second.written == [] and second.tables == first.tables and second.failed == first.failed and parts(root) == before
    got = spark.read.parquet(str(root / "leveled" / "full_merged")).collect()
    names, _ = prepare_folder(spark, str(root))
    assert sorted(names) == sorted(first.tables)
    assert sorted(spark.read.parquet(str(root / "leveled" / "full_merged")).collect()) == sorted(got)


def test_only_what_changed_is_made_anew(spark, root):
    names = [f"leveled/{t}" for t in prepare_changed(spark, str(root)).tables]
    (root / "sch.csv").write_text("Intl. School ID,size\n0,11\n1,20\n2,30\n")
    later(root / "sch.csv")
    assert prepare_changed(spark, str(root)).written == ["labeled/sch", "cleaned/sch", *names]
    merged = spark.read.parquet(str(root / "leveled" / "full_merged"))
    assert {r["size"] for r in merged.select("size").collect()} == {11, 20, 30}
    strict = Thresholds(missing=0.5)
    assert prepare_changed(spark, str(root), thresholds=strict).written == ["cleaned/sch", "cleaned/stu", *names]
    (root / "cleaned" / "stu" / "_SUCCESS").unlink()
    assert prepare_changed(spark, str(root), thresholds=strict).written == ["cleaned/stu", *names]
    (root / "sch.csv").unlink()
    assert prepare_changed(spark, str(root), thresholds=strict).written[0].startswith("leveled/")


def test_a_lost_run_goes_on(spark, root, monkeypatch):
    with monkeypatch.context() as patch:
        patch.setattr(changed, "transform_stage", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            prepare_changed(spark, str(root))
    again = prepare_changed(spark, str(root))
    assert again.written == [f"leveled/{t}" for t in again.tables] and "full_merged" in again.tables


def test_parts_of_a_data_file_count(spark, tmp_path):
    syntax = f"""* x.
DATA LIST FILE "c:\\d\\stu.dat"
CNT 1 - 3 (A)
SCH 4 - 5 (A)
STU 6 - 7 (A)
PV1 8 - 12 (F,1)
VARIABLE LABELS
SCH "School ID"
STU "Student ID"
PV1 "{PV}"
"""
    (tmp_path / "stu.sps").write_text(syntax)
    (tmp_path / "stu.dat").mkdir()
    (tmp_path / "stu.dat" / "part-0").write_text("MEX 1 1400.0\nMEX 1 2 700\n")
    first = prepare_changed(spark, str(tmp_path))
    if first.failed:
        pytest.fail(f"{first.failed}")
    assert prepare_changed(spark, str(tmp_path)).written == []
    (tmp_path / "stu.dat" / "part-1").write_text("MEX 2 4 358\n")
    assert prepare_changed(spark, str(tmp_path)).written == first.written
    assert spark.read.parquet(str(tmp_path / "labeled" / "stu")).count() == 3


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "note.md").write_text("x")
    assert prepare_changed(spark, str(tmp_path)) == ([], [], {})
