import pytest
from pyspark.sql import functions as F

from panelwright.operators import ranking
from panelwright.operators.roles import Roles
from panelwright.plans.clean import clean
from panelwright.plans.prepare import Thresholds, prepare
from panelwright.plans.results import context_of_path, process_results, save_top_selection
from panelwright.plans.transform import level_table, transform
from panelwright.sinks.writers import read_stage
from panelwright.sources.model_output import (
    normalise_scores,
    parse_ranking_lines,
    parse_selection_texts,
    read_rankings,
    read_selections,
)
from workloads import cells, rankings, registry

PV = "Plausible Value 1 in Mathematics"
SCHOOL, STUDENT = "Intl. School ID", "Intl. Student ID"


@pytest.fixture
def students(spark):
    scores = [358.76, 358.77, 500.0, 669.3, None, 420.07, 300.0, 610.0]
    data = [
        ("MEX", 1 + k // 2 if k != 7 else None, 100 + k, "Girl" if k % 2 else "Boy, 'x'", ["Missing", "0-10", "11-25", "N/A"][k % 4],
         [15.0, 16.5, 9997.0, 9990.0, 15.5, 14.0, 16.0, 15.2][k], ["1", "1d", "12F", " 3 ", "1e3", "2", "4", "5"][k], "same",
         None, 0.0, 1.5, scores[k], 10.0 + k)
        for k in range(8)
    ]
    df = spark.createDataFrame(data, f"`Country code 3-character` string, `{SCHOOL}` long, `{STUDENT}` long, `Student's gender, \"self-report\"` string, "
                               "`Books at home` string, Age double, `Index code` string, Constant string, `All missing` double, `Twin of age` double, "
                               f"`Final student weight` double, `{PV}` double, `Plausible Value 1 in Reading` double")
    return df.withColumn("Twin of age", F.when(F.col("Age") <= 9990, F.col("Age") * 2))


@pytest.fixture
def schools(spark):
    return spark.createDataFrame([(1, "XXX", 100.0, "public"), (2, "XXX", 9991.0, "private"), (None, "XXX", 5.0, "none")],
                                 f"`{SCHOOL}` long, `Country code 3-character` string, `School size` double, `School type` string")


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_clean(spark, students, partitions):
    result = clean(students.repartition(partitions), [STUDENT, SCHOOL], 0.9, 1.0, 0.99, PV)
    assert result.correlated in (["Age"], ["Twin of age"])
    assert set(result.uniform) == {"Country code 3-character", "Constant", "Final student weight"}
    assert result.sparse == ["All missing"]
    assert "Student s gender self-report" in result.table.columns and PV in result.table.columns
    types = dict(result.table.dtypes)
    assert types["Index code"] == "string" and types[STUDENT] == "bigint"
    books = {r["Books at home"] for r in result.table.collect()}
    assert books == {None, "0-10", "11-25"}
    copied = clean(students.repartition(partitions), [STUDENT, SCHOOL], 0.9, 1.0, 0.99, PV, materialise=True)
    assert copied[1:] == result[1:] and sorted(map(str, copied.table.collect())) == sorted(map(str, result.table.collect()))
    again = clean(result.table, [STUDENT, SCHOOL], 0.9, 1.0, 0.99, PV)
    assert again.table.columns == result.table.columns
    assert sorted(map(str, again.table.collect())) == sorted(map(str, result.table.collect()))


def test_clean_sentinels_and_defaults(spark, students):
    result = clean(students, [STUDENT])
    ages = {r["Age"] for r in result.table.collect()}
    assert 9990.0 in ages and 9997.0 not in ages
    assert result.correlated == [] and result.sparse == []
    large = clean(spark.createDataFrame([(99999, 1), (99998, 2)], "`id's` int, x int"), ["id's"])
    assert {r["id s"] for r in large.table.collect()} == {99999.0, 99998.0}


def test_strict_mode_drops_uniform_ids(spark):
    df = spark.createDataFrame([(1, 5), (1, 6)], "id int, x int")
    assert clean(df, ["id"]).uniform == [] and clean(df, ["id"], strict_reference=True).uniform == ["id"]


def test_transform(spark, students, schools):
    done = transform({"schools": schools, "students": students}, PV, [STUDENT, SCHOOL])
    assert list(done) == ["students", "schools", "full_merged"]
    merged = done["full_merged"]
    assert merged.columns[-2:] == [PV, f"{PV}_level"] and "Final student weight" not in merged.columns
    assert "Plausible Value 1 in Reading" not in merged.columns
    rows = {r[STUDENT]: r for r in merged.collect()}
    assert len(rows) == 8 and {r["Country code 3-character"] for r in rows.values()} == {"MEX"}
    assert [rows[100 + k][f"{PV}_level"] for k in range(8)] == [
        "Below Level 1", "Level 1", "Level 3", "Level 6", None, "Level 2", "Below Level 1", "Level 5"]
    assert rows[107]["School type"] is None and rows[100]["School type"] == "public"
    assert {r[STUDENT]: r["School type"] for r in transform({"s": students, "t": schools}, PV, [SCHOOL], null_safe=True)["full_merged"].collect()}[107] == "none"
    with pytest.raises(ValueError):
        transform({"s": students}, "")
    assert transform({"t": schools}, PV) == {}
    assert f"{PV}_level" in level_table(students, PV).columns


def test_transform_of_split_tables(spark, students):
    done = transform({"s": students}, PV, [STUDENT], split_ranges=[(0, 4)])
    assert list(done) == ["s_part2", "s_part1", "full_merged"]
    assert done["full_merged"].count() == 8


def test_prepare_writes_every_stage(spark, students, schools, tmp_path):
    root = str(tmp_path / "study")
    names = prepare(spark, root, {"students": students, "schools": schools}, Thresholds(0.9, 1.0, 1.0))
    assert names == ["students", "schools", "full_merged"]
    final = read_stage(spark, root, "leveled", "full_merged")
    assert final.count() == 8 and "All missing" not in final.columns and f"{PV}_level" in final.columns
    assert {r["School size"] for r in final.collect()} == {100.0, None}
    assert "All missing" in read_stage(spark, root, "labeled", "students").columns
    assert prepare(spark, root, {}) == []
    assert prepare(spark, str(tmp_path / "none"), {"schools": schools}, given=Roles()) == []


RANKING = "Ranked attributes:\n 0.512     7 Books at home\n 0.256     3 School size\n-0.0123    4 Age\nnoise 1.2.3 4 bad\n"
SELECTION = "=== run ===\n\nSelected attributes: 3,7 : 2\n                     School size\n                     Books at home\n\nother\nlines\n"


@pytest.fixture
def results(tmp_path):
    folder = tmp_path / "output"
    folder.mkdir()
    (folder / "STU2015_CORR.txt").write_text(RANKING)
    (folder / "stu2015_Gain").write_text("4.0 7 Books at home\n8.0 4 Age\n2.0 4 Age\n")
    (folder / "STU2015_OTHER.txt").write_text("9 9 Ignored\n")
    (folder / "SCH2015_CORR.txt").write_text("0 1 School size\n")
    (folder / "STU2015_Subset.txt").write_text(SELECTION)
    (folder / "STU2015_wrapper.txt").write_text("Selected attributes: 4\r\n  Age\r\n  Extra\r\n")
    return str(folder)


def test_ranking_lines(spark, rows):
    lines = spark.createDataFrame([("f", l) for l in RANKING.splitlines()], "file string, line string")
    assert rows(parse_ranking_lines(lines), "score", "number", "attribute") == [(-0.0123, 4, "Age"), (0.256, 3, "School size"), (0.512, 7, "Books at home")]
    assert (0.0123, 4, "Age") in rows(parse_ranking_lines(lines, strict_reference=True), "score", "number", "attribute")
    zero = spark.createDataFrame([("z", 0.0), ("n", 2.0), ("n", 1.0)], "file string, score double")
    assert rows(normalise_scores(zero)) == [("n", 1.0, 0.5), ("n", 2.0, 1.0), ("z", 0.0, 0.0)]


def test_selection_blocks(spark, rows):
    texts = spark.createDataFrame([("a", SELECTION + "\nSelected attributes:\n  later\n"), ("b", "nothing here")], "file string, text string")
    assert rows(parse_selection_texts(texts), "file", "block", "attribute", "attribute_id") == [
        ("a", 0, "Books at home", 7), ("a", 0, "School size", 3), ("a", 1, "later", 0)]


def test_reading_model_output(spark, results, rows):
    ranked = read_rankings(spark, results, ["stu2015", "SCH2015"])
    assert rows(ranked, "result_name", "method", "attribute", "score") == [
        ("SCH2015", "CORR", "School size", 0.0), ("stu2015", "CORR", "Age", -0.0123), ("stu2015", "CORR", "Books at home", 0.512),
        ("stu2015", "CORR", "School size", 0.256), ("stu2015", "GAIN", "Age", 2.0), ("stu2015", "GAIN", "Age", 8.0), ("stu2015", "GAIN", "Books at home", 4.0)]
    chosen = read_selections(spark, results, ["STU2015"])
    assert rows(chosen, "filter", "filter_idx", "attribute", "attribute_id") == [
        ("subset", 0, "Books at home", 7), ("subset", 0, "School size", 3), ("wrapper", 1, "Age", 4), ("wrapper", 1, "Extra", 0)]


def test_results_end_to_end(spark, results, tmp_path):
    data = spark.createDataFrame([(1, 2.0, "x", 15.0, "L1")], f"`{STUDENT}` int, `School size` double, `Books at home` string, `Age\\v` double, `{PV}_level` string")
    done = process_results(spark, results, data, ["STU2015", "SCH2015"], {"STU2015": [STUDENT, "absent"]}, top=2)
    summary = {(r["result_name"], r["Rank"]): (r["Attribute_Name"], r["Score"], r["Attribute_ID"]) for r in done.summary.collect()}
    # Books: (1 + 0.5) / 2 x 0.25 + 0.30; Age: the last line of a file counts, (-0.0123 / 0.512 + 2 / 8) / 2 x 0.25 + 0.45.
    assert summary == {
        ("STU2015", 1): ("Books at home", 0.4875, 7), ("STU2015", 2): ("Age", round((-0.0123 / 0.512 + 0.25) / 2 * 0.25 + 0.45, 4), 4),
        ("SCH2015", 1): ("School size", 0.0, 1)}
    assert {tuple(r) for r in done.overall.collect()} == {("STU2015", "Books at home"), ("SCH2015", "School size")}
    assert done.subsets["STU2015"].columns == ["Books at home", "Age", STUDENT]
    assert done.subsets["SCH2015"].columns == ["School size"]
    written = save_top_selection(done.summary, data, str(tmp_path / "saved"), 2)
    assert sorted(written) == ["Data_SCH2015", "Data_STU2015", "Rank_SCH2015", "Rank_STU2015"]
    assert spark.read.parquet(written["Data_STU2015"]).columns == ["Books at home", "Age", STUDENT, f"{PV}_level"]
    rank = spark.read.parquet(written["Rank_STU2015"]).orderBy("Rank").collect()
    assert [(r["mapped_dataset_column"], r["match_type"]) for r in rank] == [("Books at home", "exact"), ("Age", "exact")]


def test_ids_by_name_only_where_files_differ(spark):
    lines = [("a", "f1", 1, 1.0, 5, "x"), ("a", "f2", 1, 1.0, 6, "x"), ("a", "f1", 2, 0.5, 9, "b"), ("c", "f3", 1, 1.0, 7, "x")]
    rankings = spark.createDataFrame(lines, "result_name string, file string, line_no int, score double, number int, attribute string")
    ids = {(r["result_name"], r["attribute"]): r["attribute_id"] for r in ranking.with_attribute_ids(ranking.mean_rankings(rankings)).collect()}
    assert ids == {("a", "b"): 1, ("a", "x"): 2, ("c", "x"): 7}


def test_weights_repeat_the_last_one(spark):
    means = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.5)], "result_name string, attribute string, mean_score double")
    chosen = spark.createDataFrame([("a", "x", 0), ("a", "x", 0), ("a", "x", 2), ("a", "z", 1)], "result_name string, attribute string, filter_idx int")
    scores = {r["attribute"]: r["score"] for r in ranking.ensemble_scores(means, chosen, 3, [0.5, 0.25]).collect()}
    assert scores == {"x": 0.5 + 0.25 + 0.25, "y": 0.25}
    assert ranking.ensemble_scores(means, chosen, 0).count() == 2


def test_context_from_a_path():
    assert context_of_path("/data/STU2015.csv") == "STU2015" and context_of_path("/data/STU2015/") == "STU2015"


@pytest.fixture(scope="module")
def dense_parts(spark, tmp_path_factory):
    """A part table of many rows in one small file; some rows come twice, some keys are missing."""
    root = str(tmp_path_factory.mktemp("dense"))
    rows = spark.range(250_000).select(
        F.when(F.col("id") % 1000 != 7, F.col("id") % 240_000).alias("p_partkey"), F.lit("name").alias("p_name"),
        F.concat(F.lit("Brand#"), (F.col("id") % 3).cast("string")).alias("p_brand"), F.lit("ECONOMY").alias("p_type"),
        (F.col("id") % 50).cast("int").alias("p_size"), F.lit(9.5).alias("p_retailprice"))
    rows.coalesce(1).write.parquet(f"{root}/part.parquet")
    return root


def test_dense_syntax_texts_are_dealt_over_tasks(spark, dense_parts):
    texts = cells._syntax_texts(spark, dense_parts)
    assert texts.rdd.getNumPartitions() == 3 and texts.count() == 250_000
    small = spark.range(5).coalesce(1)
    assert registry.spread(small) is small


def test_dense_ranking_lines_are_dealt_over_tasks_and_parsed_once(spark, dense_parts):
    assert rankings._ranking_lines(spark, dense_parts).rdd.getNumPartitions() == 3
    assert rankings._selections(spark, dense_parts).rdd.getNumPartitions() == 3
    lines = spark.createDataFrame([("c", "c_CORR", "CORR", 1, "2.0 1 a"), ("c", "c_CORR", "CORR", 2, "1.0 2 b")],
                                  "result_name string, file string, method string, line_no int, line string")
    means = ranking.mean_rankings(parse_ranking_lines(lines))
    assert "regexp" not in means._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["attribute"], r["mean_score"]) for r in means.collect()) == [("a", 1.0), ("b", 0.5)]


def test_file_names_are_read_once_per_file(spark, tmp_path):
    """Odd characters in names, files of several contexts; a line carries its path only and is walked once."""
    (tmp_path / "A#1+B 2%_CORR.txt").write_text("2.0 1 a\n1.0 2 b\n")
    (tmp_path / "other_CORR.txt").write_text("9.0 1 z\n")
    (tmp_path / "A#1_wrapper_subset.txt").write_text("Selected attributes: 4 : 1\n  a\n")
    scored = read_rankings(spark, str(tmp_path), ["a#1", "B 2", "none"])
    assert sorted((r["result_name"], r["file"], r["method"], r["score"]) for r in scored.collect()) == sorted(
        (c, "A#1+B 2%_CORR.txt", "CORR", x) for c in ("a#1", "B 2") for x in (1.0, 2.0))
    chosen = read_selections(spark, str(tmp_path), ["A#1"])
    assert sorted((r["file"], r["filter"], r["attribute"], r["attribute_id"]) for r in chosen.collect()) == [
        ("A#1_wrapper_subset.txt", kind, "a", 4) for kind in ("subset", "wrapper")]
    for df in (scored, chosen):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "url_decode" not in plan.lower() and "UrlCodec" not in plan and "MapInArrow" not in plan
    assert read_rankings(spark, str(tmp_path), ["none"]).count() == 0 == read_selections(spark, str(tmp_path), ["none"]).count()
