import pytest
from pyspark.sql import functions as F

from panelwright.operators.columns import (
    clean_values,
    drop_marked,
    drop_unwanted,
    missing_labels_as_null,
    nan_as_null,
    not_numeric,
    numbers_or_categories,
    select_existing,
    select_required,
    sentinels_as_null,
    split_columns,
)
from panelwright.operators.joins import find_score_table, left_join, membership, other_tables, side_by_side, star_join
from panelwright.operators.labels import decode_labels, label_headers
from panelwright.operators.matching import match_names
from panelwright.operators.roles import Roles, best_roles, detect_roles, essential_columns

PV = "Plausible Value 1 in Mathematics"


def test_left_join_keeps_left_columns_and_moves_the_score(spark, rows):
    left = spark.createDataFrame([(1, 5.0, "L"), (2, 6.0, "L"), (None, 7.0, "L")], f"k int, `{PV}` double, s string")
    right = spark.createDataFrame([(1, "R", 10), (1, "R", 11), (None, "R", 12), (9, "R", 13)], "k int, S string, x int")
    joined = left_join(left, right, "k")
    assert joined.columns == ["k", "s", "x", PV]
    assert rows(joined) == [(None, "L", None, 7.0), (1, "L", 10, 5.0), (1, "L", 11, 5.0), (2, "L", None, 6.0)]
    assert (None, "L", 12, 7.0) in rows(left_join(left, right, "k", null_safe=True))


def test_right_scan_reads_only_new_columns(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("k"), F.lit("x").alias("s"), F.lit(1).alias("n")).write.parquet(str(tmp_path / "r"))
    left = spark.range(5).select(F.col("id").alias("k"), F.lit("l").alias("s"))
    plan = left_join(left, spark.read.parquet(str(tmp_path / "r")), "k")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<k:bigint,n:int>" in plan


def test_star_join_has_no_fan_out(spark, rows):
    students = spark.createDataFrame([(1, 10, 1.0), (1, 11, 2.0), (2, 12, 3.0)], "school int, student int, score double")
    schools = spark.createDataFrame([(1, "a"), (2, "b")], "school int, kind string")
    homes = spark.createDataFrame([(10, 5), (12, 6)], "student int, books int")
    alone = spark.createDataFrame([(1,)], "other int")
    tables = {"homes": homes, "students": students, "schools": schools, "alone": alone}
    assert find_score_table(tables, "score") == "students" and find_score_table(tables, "x") is None
    assert list(other_tables(tables, "homes")) == ["students", "schools", "alone"]
    done = star_join(tables, "score", ["student", "school"])
    assert list(done) == ["students", "homes", "schools", "full_merged"]
    assert rows(done["full_merged"].select("student", "books", "kind")) == [(10, 5, "a"), (11, None, "a"), (12, 6, "b")]
    assert star_join(tables, "absent") == {}
    assert list(star_join({"s": students, "alone": alone}, "score")) == ["s"]


def test_self_join_of_split_parts(spark, rows):
    df = spark.createDataFrame([(1, 2.0, "x"), (2, 3.0, "y")], "id int, score double, c string")
    first, second = split_columns(df, [(1, 2)], ["id", "absent"])
    assert (first.columns, second.columns) == (["id", "score"], ["id", "c"])
    assert rows(star_join({"p1": first, "p2": second}, "score", ["id"])["full_merged"]) == [(1, 2.0, "x"), (2, 3.0, "y")]


def test_membership_adds_no_rows(spark, rows):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    members = spark.createDataFrame([(1,), (1,)], "k int")
    assert rows(membership(df, members, ["k"], "there")) == [(1, True), (2, False)]


def test_value_cleaning_of_a_table(spark):
    df = spark.createDataFrame([(1, " a,'b' ", float("nan"), "Missing", 9999)], "i int, t string, d double, m string, n int")
    row = sentinels_as_null(missing_labels_as_null(clean_values(nan_as_null(df))), ["i"]).first()
    assert tuple(row) == (1, "a b", None, None, None)
    assert missing_labels_as_null(df, columns=["t"]).first()["m"] == "Missing"
    assert sentinels_as_null(df, ["n"]).first()["n"] == 9999


@pytest.mark.parametrize("limit", [60, 0])
def test_numeric_or_category(spark, monkeypatch, limit):
    from panelwright.operators import columns
    monkeypatch.setattr(columns, "WIDE_LIMIT", limit)
    df = spark.createDataFrame([("1", "1d", None, "1e3", True, 3), (" 3 ", "2", None, None, False, 4)], "a string, b string, c string, d string, e boolean, f int")
    typed, mixed = numbers_or_categories(df)
    assert mixed == ["b"]
    assert dict(typed.dtypes) == {"a": "bigint", "b": "string", "c": "double", "d": "double", "e": "double", "f": "bigint"}
    assert [tuple(r) for r in typed.collect()] == [(1.0, "1d", None, 1000.0, 1.0, 3.0), (3.0, "2", None, None, 0.0, 4.0)]
    assert {r["col"]: r["mixed"] for r in not_numeric(df, ["a", "b", "c"]).collect()} == {"a": False, "b": True, "c": False}


def test_column_choice(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, `Final w` int")
    kept, unknown = drop_unwanted(df, ["b", "zz"])
    assert kept.columns == ["a"] and unknown == ["zz"]
    assert drop_marked(df, ["a", "zz"]).columns == ["b", "Final w"]
    assert select_existing(df, ["b", "zz", "a", "b"]).columns == ["b", "a"]
    with pytest.raises(ValueError, match="zz"):
        select_required(df, ["a", "zz"])


def test_roles_break_ties_by_distinct_values(spark):
    df = spark.createDataFrame([(1, 10, 5.0, 1.0), (1, 11, 6.0, 1.0), (2, 12, 7.0, None)],
                               f"`School ID` int, `Student ID` int, `{PV}` double, `Plausible Value 2 in Mathematics` double")
    roles = detect_roles(df)
    assert roles[:3] == (PV, "School ID", "Student ID") and roles.leveled_score is None
    assert detect_roles(df, Roles(school="Student ID", student="absent"))[:3] == (PV, "Student ID", "Student ID")
    assert detect_roles(df.select(F.lit(1).alias("q"))) == Roles()
    more = df.select(F.col("School ID").alias("School id number"), F.lit(3).alias("x"))
    best = best_roles({"more": more, "df": df.withColumn(f"{PV} level", F.lit("Level 1"))})
    assert best == Roles(PV, "School id number", "Student ID", f"{PV} level")


def test_essential_columns(spark):
    df = spark.createDataFrame([(1, 2, 3.0, "L")], f"`School ID` int, `Student ID` int, `{PV}` double, `{PV}_level` string")
    assert essential_columns(df) == ["School ID", "Student ID", f"{PV}_level"]
    assert essential_columns(df, ["Student ID", "zz"]) == ["Student ID", f"{PV}_level"]
    assert essential_columns(df.select(F.lit(1).alias("width"), F.lit(2).alias("x"))) == ["width"]


@pytest.mark.parametrize("limit", [64, 1, 0])
def test_labels(spark, rows, limit):
    df = spark.createDataFrame([("1", "7"), ("2", "8"), ("x", None), (None, "7")], "A string, B string")
    labels = spark.createDataFrame([("A", "1", "one"), ("A", "'2'", "two"), ("B", " 7", "seven"), ("C", "1", "no")], "name string, code string, label string")
    named = label_headers(decode_labels(df, labels, limit), [("A", "Label"), ("B", "label")])
    assert named.columns == ["Label", "label_2"]
    assert rows(named) == [(None, "seven"), ("one", "seven"), ("two", "8"), ("x", None)]


def test_number_codes_match_text_codes(spark):
    labels = spark.createDataFrame([("A", "1", "one")], "name string, code string, label string")
    assert [r[0] for r in decode_labels(spark.createDataFrame([(1,), (2,)], "A int"), labels).collect()] == ["one", "2"]


def test_fuzzy_names(spark):
    columns = ["Books at home", "Respondent country of birth, category A", "Respondent country of birth, category B", "a\\b"]
    names = ["Books at home", "Books at hone", "Respondent country of hirth, category B", "ab", None, "", "Books at home"]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string")
    got = [(r["mapped_dataset_column"], r["match_type"]) for r in match_names(df, "n", columns).orderBy("k").collect()]
    assert got == [("Books at home", "exact"), (None, "none"), (columns[2], "fuzzy"), ("ab", "exact"), (None, "none"), (None, "none"), ("Books at home", "exact")]
    assert match_names(df, "n", columns, fuzzy=False).filter("match_type = 'fuzzy'").count() == 0


def test_long_integers_keep_their_digits(spark):
    df = spark.createDataFrame([("9007199254740993", "99999999999999999999", "1.5"), ("9007199254740992", "1", None)], "a string, b string, id string")
    typed, mixed = numbers_or_categories(df, protected=["id"])
    assert mixed == [] and dict(typed.dtypes) == {"a": "bigint", "b": "double", "id": "string"}
    assert [r["a"] for r in typed.collect()] == [9007199254740993, 9007199254740992]


def test_tables_of_one_key_are_joined_side_by_side(spark, rows):
    base = spark.createDataFrame([(1, 2.0), (2, 3.0), (None, 4.0)], "k int, score double")
    first = spark.createDataFrame([(1, "a"), (1, "b"), (None, "n")], "k int, c string")
    second = spark.createDataFrame([(2, "x", "hidden"), (1, "y", "hidden")], "k int, d string, c string")
    full = star_join({"base": base, "one": first, "two": second}, "score", ["k"])["full_merged"]
    one_by_one = left_join(left_join(base, first, "k"), second, "k")
    assert full.columns == one_by_one.columns and rows(full) == rows(one_by_one)


def spread(df):
    """Rows per task behind the last exchange, most and median."""
    counts = sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    return counts[-1], counts[len(counts) // 2]


@pytest.fixture
def no_broadcast(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("null_safe", [False, True])
def test_hot_keys_are_spread_over_tasks(spark, no_broadcast, rows, null_safe):
    hot = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 97 + 100).cast("long").alias("key")
    base = spark.range(4000).select("id", hot, F.col("id").cast("double").alias("score"))
    a = spark.range(160).select(hot, F.col("id").alias("a"))
    b = spark.range(12).select(F.when(F.col("id") < 4, 7).when(F.col("id") == 4, F.lit(None)).otherwise(F.col("id") + 100).cast("long").alias("key"), F.col("id").alias("b"))
    done = star_join({"base": base, "a": a, "b": b}, "score", ["key"], null_safe)
    base.createOrReplaceTempView("t_base"), a.createOrReplaceTempView("t_a"), b.createOrReplaceTempView("t_b")
    on = "<=>" if null_safe else "="
    for name, sql in (
        ("a", f"SELECT t_base.*, a FROM t_base LEFT JOIN t_a ON t_base.key {on} t_a.key"),
        ("b", f"SELECT t_base.*, b FROM t_base LEFT JOIN t_b ON t_base.key {on} t_b.key"),
        ("full_merged", f"SELECT t_base.*, a, b FROM t_base LEFT JOIN t_a ON t_base.key {on} t_a.key LEFT JOIN t_b ON t_base.key {on} t_b.key"),
    ):
        columns = ["id", "key", "score", *[c for c in ("a", "b") if c in done[name].columns]]
        expected = spark.sql(sql).select(*columns)
        mine = done[name].select(*columns)
        assert mine.count() == expected.count() and mine.exceptAll(expected).isEmpty()
    most, median = spread(done["full_merged"])
    assert most <= 4 * median
    plain = base.join(a, "key", "left").join(b, "key", "left")
    assert spread(plain)[0] > 20 * max(spread(plain)[1], 1)


def test_sides_with_keys_of_their_own(spark, rows):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "k int, a string")
    b = spark.createDataFrame([(2, 5, "late"), (3, 6, "late"), (2, 7, "late"), (None, 8, "late")], "k int, b int, a string")
    assert rows(side_by_side([a, b], "k"), "k", "a", "b") == rows(spark.createDataFrame(
        [(1, "x", None), (2, "y", 5), (2, "y", 7), (None, "n", None), (3, None, 6), (None, None, 8)], "k int, a string, b int"))
    assert rows(side_by_side([a, b], "k", null_safe=True), "k", "a", "b") == rows(spark.createDataFrame(
        [(1, "x", None), (2, "y", 5), (2, "y", 7), (None, "n", 8), (3, None, 6)], "k int, a string, b int"))


def test_many_columns_share_one_look_up(spark, rows):
    from panelwright.operators.frequencies import encode_nominal
    from panelwright.operators.labels import decode_labels

    names = [f"c{k}" for k in range(10)]
    df = spark.range(400).select("id", *[F.when(F.col("id") % 31 != k, F.concat(F.lit("v"), (F.col("id") * (k + 3) % 157).cast("string"))).alias(n) for k, n in enumerate(names)])
    coded = encode_nominal(df, names)
    expected = df.toPandas()
    for n in names:
        values = sorted({"nan" if v is None else v for v in expected[n]})
        expected[n] = [values.index("nan" if v is None else v) for v in expected[n]]
    assert [tuple(r) for r in coded.orderBy("id").collect()] == [tuple(r) for r in expected.itertuples(index=False)]
    labels = df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("code"), F.concat(F.lit(n), F.col(n)).alias("label")) for n in names])))
    decoded = decode_labels(df, labels.distinct())
    assert decoded.columns == df.columns
    for r, d in zip(decoded.orderBy("id").collect(), df.orderBy("id").collect()):
        assert all(r[n] == (None if d[n] is None else n + d[n]) for n in names)
    plans = [decode_labels(df, labels.distinct().filter(F.col("name").isin(names[:k])), inline_limit=1)._jdf.queryExecution().executedPlan().toString()
             for k in (4, 10)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange") and "BroadcastHashJoin" not in plans[1].split("Scan")[0]


def test_clear_ties_are_broken_by_sketches(spark, monkeypatch):
    from panelwright.operators import roles as module

    df = spark.range(3000).selectExpr("id % 20 AS `School ID old`", "id AS `School ID`", "id % 3 AS `Student ID`")
    other = spark.range(500).selectExpr("id AS `School ID`", "1 AS x")
    counted = []
    exact = module.distinct_counts
    monkeypatch.setattr(module, "distinct_counts", lambda df, columns: counted.extend(columns) or exact(df, columns))
    assert detect_roles(df).school == "School ID" and counted == []
    assert best_roles({"a": other, "b": df}).school == "School ID" and counted == []
    near = spark.range(3000).selectExpr("id % 2990 AS `School ID old`", "id AS `School ID`", "id % 5 AS `School ID new`")
    assert detect_roles(near).school == "School ID" and set(counted) == {"School ID", "School ID old"}
    same = spark.range(300).selectExpr("id AS `School ID b`", "id AS `School ID a`")
    assert detect_roles(same).school == exact_first(same)


def exact_first(df):
    from panelwright.functions.names import SCHOOL_WORDS, role_candidates

    return role_candidates(df.columns, SCHOOL_WORDS)[0]
