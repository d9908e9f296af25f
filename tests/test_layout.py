"""Tables laid out by country."""

from pathlib import Path

import pytest

from panelwright.sinks.layout import scan_country, write_by_country


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """A third of the rows in one country, spelled in both cases; a number-like code, a missing and an empty one."""
    path = str(tmp_path_factory.mktemp("layout") / "labeled")
    df = spark.range(3000).selectExpr(
        "id AS `student id`", "CASE WHEN id % 3 = 0 THEN if(id % 2 = 0, 'mex', 'MEX') WHEN id % 50 = 1 THEN NULL "
        "WHEN id % 50 = 2 THEN '' WHEN id % 5 = 0 THEN '040' WHEN id % 5 = 1 THEN 'a/b=%' ELSE concat('C', id % 7) END AS CNT")
    write_by_country(df, path, look_ups=["student id"])
    return df, path


@pytest.mark.parametrize("code", ["Mex", "040", "A/b=%", "c3", "none", None, ""])
def test_rows_are_those_of_the_filter(spark, table, code):
    df, path = table
    found = scan_country(spark, path, code)
    want = df.filter(f"upper(CNT) = upper('{code}')") if code else df
    assert found.columns == df.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def files_read(df):
    """Rows of a scan, and how many files it opened by the scan's own count."""
    rows = df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return len(rows), scan.metrics().apply("numFiles").value()


def files_of(root, key):
    return len(list(root.glob(f"country_key={key}/*.parquet")))


def test_only_matching_files_are_opened(spark, table):
    df, path = table
    n, files = files_read(scan_country(spark, path, "mex"))
    assert n == df.filter("upper(CNT) = 'MEX'").count() and files == files_of(Path(path), "MEX")
    assert files < files_of(Path(path), "*")
    assert files_read(scan_country(spark, path, "none")) == (0, 0)


def test_a_large_country_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(60_000).selectExpr("if(id % 3 = 0, 'MEX', concat('C', id % 40)) AS CNT", "id", "sha2(string(id), 512) AS x")
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "512k")
    try:
        write_by_country(df, str(tmp_path / "t"))
    finally:
        spark.conf.unset(key)
    assert files_of(tmp_path / "t", "MEX") > 1
    assert scan_country(spark, str(tmp_path / "t"), "MEX").count() == 20_000


def test_look_ups_have_bloom_filters(spark, tmp_path):
    df = spark.range(20_000).selectExpr("'MEX' AS CNT", "sha2(string(id), 512) AS `the id`")
    sizes = []
    for k, look_ups in enumerate([[], ["the id"]]):
        write_by_country(df, str(tmp_path / f"t{k}"), look_ups=look_ups)
        sizes.append(sum(p.stat().st_size for p in (tmp_path / f"t{k}").rglob("*.parquet")))
    assert sizes[1] > sizes[0] + 20_000  # at least a byte per value
    one = df.limit(1).collect()[0]
    assert scan_country(spark, str(tmp_path / "t1"), "mex").filter(f"`the id` = '{one[1]}'").count() == 1


def test_refusals(spark, tmp_path):
    with pytest.raises(ValueError):
        write_by_country(spark.range(1), str(tmp_path / "a"))
    with pytest.raises(ValueError):
        write_by_country(spark.sql("SELECT 'a' AS CNT, 1 AS country_key"), str(tmp_path / "a"))
