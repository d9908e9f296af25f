import math

from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from panelwright.session import shared_folder
from pyspark.sql import functions as F

from panelwright.operators import frequencies, moments, profile


def frame(rows=300, seed=3):
    """Random numbers with gaps, ties, a constant, an all-missing column and large ids."""
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "id": 50_000_000 + np.arange(rows, dtype=float), "a": rng.normal(size=rows), "ties": rng.integers(0, 4, rows).astype(float),
        "constant": 7.0, "nothing": np.nan,
    })
    pdf["twin"] = 2 * pdf["a"]
    pdf["noisy"] = pdf["a"] + rng.normal(size=rows) / 4
    pdf["bent"] = pdf["id"] * 3 + rng.normal(size=rows)
    pdf.loc[rng.random(rows) < 0.3, "noisy"] = np.nan
    pdf.loc[rng.random(rows) < 0.2, "ties"] = np.nan
    return pdf


def to_spark(spark, pdf, partitions=3):
    df = spark.createDataFrame(pdf)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in df.columns]).repartition(partitions)


@pytest.mark.parametrize("partitions, block", [(1, 1500), (2, 3), (7, 1)])
def test_correlations_match_pandas(spark, partitions, block):
    pdf = frame()
    got = moments.correlations(to_spark(spark, pdf, partitions), list(pdf.columns), block).collect()
    expected = pdf.corr()
    assert len(got) == len(pdf.columns) * (len(pdf.columns) - 1) // 2
    for row in got:
        want = expected.loc[row["col_i"], row["col_j"]]
        if math.isnan(want):
            assert row["r"] is None
        else:
            assert row["r"] == pytest.approx(want, abs=1e-9)
            assert -1.0 <= row["r"] <= 1.0
        assert row["n"] == int((pdf[row["col_i"]].notna() & pdf[row["col_j"]].notna()).sum())


def test_columns_constant_on_shared_rows_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.1), (2.0, 5.1), (None, 9.3), (4.0, None), (7.0, 5.1)], "a double, b double")
    assert moments.correlations(df, ["a", "b"]).first()["r"] is None


def test_pair_sums_of_nothing(spark):
    df = spark.createDataFrame([], "a double, b double")
    got = moments.pair_sums(df, ["a", "b"]).collect()
    assert {(r["i"], r["j"], r["n"]) for r in got} == {(0, 0, 0.0), (1, 0, 0.0), (1, 1, 0.0)}


def brute_redundant(pdf, threshold, target=None, protected=()):
    coded = pdf.copy()
    for c in coded.columns:
        if coded[c].dtype == object:
            kinds = sorted(set(coded[c].fillna("nan")))
            coded[c] = coded[c].fillna("nan").map({k: n for n, k in enumerate(kinds)}).astype(float)
    names = [c for c in coded.columns if c != target and c not in protected]
    corr, dropped = coded[names].corr().abs(), set()
    for i, later in enumerate(names):
        for earlier in names[:i]:
            if corr.loc[later, earlier] > threshold:
                weaker = target and abs(coded[later].corr(coded[target])) < abs(coded[earlier].corr(coded[target]))
                dropped.add(later if weaker else earlier)
    return [n for n in names if n in dropped]


@pytest.mark.parametrize("target", [None, "bent", "noisy"])
@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_redundant_columns_match_brute_force(spark, target, partitions):
    pdf = frame()
    df = to_spark(spark, pdf, partitions).withColumn("word", F.concat(F.lit("w"), (F.col("id") % 3).cast("int").cast("string")))
    df = df.withColumn("word_copy", F.when(F.col("id") % 5 != 0, F.col("word")).otherwise(F.col("word")))
    local = df.toPandas()
    got = moments.redundant_columns(df, 0.9, target, ["id"])
    assert got == brute_redundant(local, 0.9, target, ["id"])
    assert "word" in got


def test_strict_mode_ignores_target_and_protection(spark):
    df = to_spark(spark, frame())
    assert moments.redundant_columns(df, 0.9, "noisy", ["a"], strict_reference=True) == brute_redundant(frame().drop(columns="noisy"), 0.9)
    assert moments.redundant_columns(df, 1.0) == []


def test_nominal_codes_inline_and_joined(spark, rows):
    df = spark.createDataFrame([("b", "x"), ("a", None), (None, "y"), ("b", "é"), ("zz", "x")], "p string, q string")
    expected = [(0, 0), (1, 1), (1, 3), (2, 2), (3, 1)]
    for limit in (64, 0, 3):
        assert rows(frequencies.encode_nominal(df, ["p", "q"], limit)) == sorted([(1, 1), (0, 0), (2, 2), (1, 3), (3, 1)]) == sorted(expected)


def test_ratios(spark, rows):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, None, None), (1, None, "y")], "a int, b string, c string")
    assert rows(frequencies.missing_ratios(df)) == [("a", 4, 0, 0.0), ("b", 4, 4, 1.0), ("c", 4, 1, 0.25)]
    assert rows(frequencies.uniformity_ratios(df)) == [("a", 4, 3, 0.75), ("b", 0, None, None), ("c", 3, 2, 2 / 3)]
    assert frequencies.sparse_columns(df, 0.25) == ["b"] and frequencies.sparse_columns(df, 0.2) == ["b", "c"]
    assert frequencies.sparse_columns(df, 1.0) == [] and frequencies.sparse_columns(df, 0.2, ["b"]) == ["c"]
    assert frequencies.uniform_columns(df, 0.75) == ["a"] and frequencies.uniform_columns(df) == []
    assert frequencies.uniform_columns(df.withColumn("k", F.lit(1.5))) == ["k"]


def test_wide_and_long_constant_scan_agree(spark, monkeypatch):
    df = spark.createDataFrame([(1, None, "x", 2.0), (1, None, "x", 3.0)], "a int, b string, c string, d double")
    wide = frequencies.constant_columns(df, df.columns)
    monkeypatch.setattr(frequencies, "WIDE_LIMIT", 0)
    assert wide == frequencies.constant_columns(df, df.columns) == ["a", "c"]


@pytest.mark.parametrize("limit", [60, 0])
def test_numeric_profile_matches_pandas(spark, monkeypatch, limit):
    monkeypatch.setattr(profile, "WIDE_LIMIT", limit)
    pdf = frame()
    got = {r["name"]: r for r in profile.numeric_profile(to_spark(spark, pdf), list(pdf.columns)).collect()}
    for name in pdf.columns:
        values, row = pdf[name].dropna(), got[name]
        assert row["unique_count"] == values.nunique()
        if values.empty:
            assert row["mean"] is None and row["median"] is None and row["histogram"] is None
            continue
        expected = [values.mean(), values.std(), values.var(), values.min(), values.max(), *values.quantile([0.25, 0.5, 0.75])]
        assert [row[c] for c in ("mean", "std", "variance", "min", "max", "q25", "median", "q75")] == pytest.approx(expected, rel=1e-9, abs=1e-12)
        counts, edges = np.histogram(values, bins=30)
        assert list(row["histogram"]["counts"]) == counts.tolist()
        assert list(row["histogram"]["bin_edges"]) == pytest.approx(edges.tolist(), rel=1e-12)


def test_sketched_quantiles_are_close(spark):
    df = spark.range(10001).select(F.col("id").cast("double").alias("x"))
    row = profile.numeric_profile(df, ["x"], exact=False).first()
    assert [row["q25"], row["median"], row["q75"]] == pytest.approx([2500, 5000, 7500], abs=5)


def test_one_value_has_no_spread(spark):
    row = profile.numeric_profile(spark.createDataFrame([(4.0,)], "x double"), ["x"]).first()
    assert (row["mean"], row["std"], row["q25"], row["unique_count"]) == (4.0, None, 4.0, 1)
    assert row["histogram"]["counts"][15] == 1 and row["histogram"]["bin_edges"][0] == 3.5


def test_categorical_profile_with_rest(spark):
    words = [(f"w{k:02d}",) for k in range(25) for _ in range(k + 1)]
    df = spark.createDataFrame(words, "w string").withColumn("none", F.lit(None).cast("string"))
    got = {r["name"]: r for r in frequencies.categorical_profile(df, ["w", "none"]).collect()}
    assert got["w"]["unique_count"] == 25 and got["w"]["most_common"] == "w24" and got["w"]["most_common_count"] == 25
    counts = [(v["value"], v["count"]) for v in got["w"]["value_counts"]]
    assert counts == [(f"w{k:02d}", k + 1) for k in range(24, 4, -1)] + [("__OTHER__", 15)]
    assert got["none"]["unique_count"] == 0 and got["none"]["value_counts"] == [] and got["none"]["most_common"] is None


def test_common_profile_counts_nan_as_missing(spark, rows):
    df = spark.createDataFrame([(1.0, "x"), (math.nan, None), (None, "y"), (2.0, "y")], "a double, b string")
    assert rows(profile.common_profile(df)) == [("a", "double", 4, 2, 50.0, 2), ("b", "string", 4, 1, 25.0, 3)]
    kinds = {r["name"]: (r["type"], r["unique_count"]) for r in profile.profile(df).collect()}
    assert kinds == {"a": ("numeric", 2), "b": ("categorical", 2)}


@pytest.mark.parametrize("threshold", [0.01, 0.03, 0.2, 0.5, 0.75, 0.9])
def test_sketched_uniform_columns_match_exact_counts(spark, threshold):
    rng = np.random.default_rng(9)
    rows = 5000
    pdf = pd.DataFrame({
        "id": np.arange(rows), "half": np.where(np.arange(rows) < rows / 2, -1, np.arange(rows)), "most": (rng.random(rows) < 0.1) * rng.random(rows),
        "word": np.where(rng.random(rows) < 0.76, "same", rng.integers(0, 3000, rows).astype(str)), "flag": rng.random(rows) < 0.2,
        "zipf": rng.zipf(1.7, rows), "gaps": np.where(rng.random(rows) < 0.9, np.nan, 3.5),
    })
    df = to_spark_any(spark, pdf)
    expected = [c for c in pdf.columns if pdf[c].value_counts().max() / pdf[c].notna().sum() >= threshold]
    assert frequencies.uniform_columns(df, threshold) == expected
    exact = {r["col"]: r["ratio"] for r in frequencies.uniformity_ratios(df).collect()}
    assert [c for c in pdf.columns if exact[c] >= threshold] == expected


def to_spark_any(spark, pdf):
    df = spark.createDataFrame(pdf).repartition(5)
    return df.withColumn("gaps", F.when(~F.isnan("gaps"), F.col("gaps"))).withColumn("flag", F.col("flag").cast("boolean"))


@pytest.mark.parametrize("limit", [0, 60])
def test_limits_do_not_change_answers(spark, limit):
    df = spark.createDataFrame([(0.0, 9007199254740993, "x", float("nan")), (-0.0, 9007199254740992, None, float("nan"))],
                               "zero double, near bigint, text string, nan double")
    assert frequencies.constant_columns(df, df.columns, limit) == ["zero", "text", "nan"]
    assert frequencies.constant_columns(df.limit(0), df.columns, limit) == []
    empty = profile.numeric_moments(df.limit(0), ["zero", "near"], limit).collect()
    assert sorted((r["col"], r["present"], r["mean"]) for r in empty) == [("near", 0, None), ("zero", 0, None)]


def test_codes_of_an_empty_table_are_numbers(spark):
    df = spark.createDataFrame([("a",)], "c string")
    assert frequencies.encode_nominal(df.limit(0), ["c"]).dtypes == frequencies.encode_nominal(df, ["c"]).dtypes == [("c", "bigint")]


def test_histogram_has_no_exchange_on_the_column_alone(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbers = profile.number_frequencies(spark.range(100).selectExpr("id * 1.0D AS x"), ["x"])
        plan = profile.histogram_counts(numbers, profile.value_limits(numbers))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    join = plan[: plan.index("BroadcastHashJoin")]
    assert "hashpartitioning(col" in join and "SortMergeJoin" not in plan
    assert all(", bin" in line or "lo#" in line for line in join.splitlines() if "hashpartitioning(col" in line)


def test_selection_finds_values_at_places(spark, monkeypatch):
    from panelwright.operators import selection

    deal = np.random.default_rng(11)
    n = 3000
    table = {
        "normal": deal.normal(size=n), "wide": deal.choice([-1.0, 1.0], n) * 2.0 ** deal.integers(-1070, 1020, n),
        "few": deal.integers(0, 3, n).astype(float), "near": 1e15 + deal.integers(0, 9, n), "zeros": np.where(deal.random(n) < 0.9, 0.0, -5e-324),
        "ends": np.where(deal.random(n) < 0.5, np.inf, -np.inf), "gaps": np.where(deal.random(n) < 0.7, np.nan, deal.random(n)),
        "none": np.full(n, np.nan), "one": np.where(np.arange(n) == 5, 7.0, np.nan), "ids": np.arange(n) * 3.0,
    }
    df = spark.createDataFrame([tuple(None if np.isnan(x) and k % 2 else float(x) for x in row) for k, row in enumerate(zip(*table.values()))],
                               ", ".join(f"`{c}` double" for c in table)).repartition(5)
    places_of = lambda total: [p for p in {0, 1, total // 4, total // 2, total // 2 + 1, total - 1} if 0 <= p < total]
    for few, bins in ((selection.FEW_ROWS, selection.BINS), (3, 4)):
        monkeypatch.setattr(selection, "FEW_ROWS", few)
        monkeypatch.setattr(selection, "BINS", bins)
        monkeypatch.setattr(selection, "COLUMNS_AT_ONCE", 4)
        names = list(table) if few > 3 else ["normal", "wide", "near", "gaps"]
        for name, (total, at) in zip(names, selection.values_at_places(df, names, places_of)):
            values = np.sort(table[name][~np.isnan(table[name])])
            assert total == len(values) and at == {p: values[p] for p in places_of(total)}
    quantiles = selection.selected_quantiles(df, ["normal", "none", "one"], [0.25, 0.5])
    assert quantiles[1] is None and quantiles[2] == [7.0, 7.0]
    assert quantiles[0] == pytest.approx(np.quantile(table["normal"], [0.25, 0.5]).tolist(), rel=1e-12)
    assert selection.selected_quantiles(df.limit(0), ["normal"], [0.5]) == [None]


def test_numeric_profile_neither_sorts_nor_writes(spark, tmp_path):
    before = set(Path(shared_folder(spark)).rglob("*.parquet")) if Path(shared_folder(spark)).exists() else set()
    df = spark.range(5000).selectExpr("id * 1.0D AS x", "id % 7 AS y")
    plan = profile.numeric_profile(df, ["x", "y"])
    assert "rangepartitioning" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {r["name"]: r["median"] for r in plan.collect()} == {"x": 2499.5, "y": 3.0}
    assert set(Path(shared_folder(spark)).rglob("*.parquet")) == before
