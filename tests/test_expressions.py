import math

import pytest
from pyspark.sql import functions as F

from panelwright.functions import names, text
from panelwright.functions.levels import proficiency_level


def values(spark, expression, items, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(items)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(expression(F.col("v"))).collect()]


def test_strip_removes_every_kind_of_white_space(spark):
    items = ["  a b ", "\t\n a\x0b", "\xa0é ", "", "   ", None, "x", "\x1fq\x1c"]
    expected = [v.strip() if v is not None else None for v in items]
    assert values(spark, text.strip, items) == expected


def test_clean_value(spark):
    items = ["it's\ta \"b\", c\\\n", None, ",\"\\", " 1,234 "]
    assert values(spark, text.clean_value, items) == ["it s a b c", None, "", "1234"]


def test_newlines_become_marks(spark):
    assert values(spark, text.escape_newlines, ["a\nb\r", "\n", None]) == ["a\\nb\\n", "\\n", None]


def test_attribute_clean_matches_name_rule(spark):
    items = ["a\\vb", " x\x01\\ ", "plain", "\\"]
    assert values(spark, text.clean_attribute, items) == [names.clean_attribute_name(i) for i in items] == ["ab", "x", "plain", ""]


@pytest.mark.parametrize("value, number", [
    ("1", 1.0), (" 3 ", 3.0), ("1e3", 1000.0), ("-.5", -0.5), ("+2.", 2.0), ("1d", None), ("12F", None), ("NaN", None),
    ("inf", None), ("", None), ("1_0", None), ("0x10", None), (None, None), ("1,5", None),
])
def test_parse_number(spark, value, number):
    assert values(spark, text.parse_number, [value]) == [number]
    bad = values(spark, text.is_bad_number, [value])[0]
    assert bool(bad) == (value is not None and number is None)


def test_sentinel_boundary_is_exclusive(spark):
    assert values(spark, text.sentinel_to_null, [9990.0, 9990.1, None, -1.0], "double") == [9990.0, None, None, -1.0]


def test_country_tests(spark):
    assert values(spark, lambda c: text.equals_code(c, "mex"), ["MEX", "mEx", "USA", None]) == [True, True, False, None]
    assert values(spark, lambda c: text.starts_with_code(c, "MEX"), ["MEX1", "mex1"]) == [True, False]
    assert values(spark, lambda c: text.starts_with_code(c, ""), ["a"]) == [True]


def test_short_codes_are_pushed_to_the_scan(spark, tmp_path):
    assert sorted(text.spellings("ME")) == ["ME", "Me", "mE", "me"]
    assert "\u017fwe" in text.spellings("SWE") and all(s.upper() == "SWE" for s in text.spellings("SWE"))
    spark.createDataFrame([("MEX",)], "CNT string").write.parquet(str(tmp_path / "c"))
    plan = spark.read.parquet(str(tmp_path / "c")).filter(text.equals_code(F.col("CNT"), "mex"))
    assert "PushedFilters: [In(CNT" in plan._jdf.queryExecution().executedPlan().toString()
    assert values(spark, lambda c: text.equals_code(c, "Mexico"), ["MEXICO", "mexicO", None]) == [True, True, None]


def test_code_page_round_trip(spark):
    every = bytes(b for b in range(256) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
    latin, real = every.decode("latin-1"), every.decode("cp1252")
    assert values(spark, text.from_cp1252, [latin]) == [real]
    assert values(spark, text.to_cp1252, [real]) == [latin]


def test_year(spark):
    assert values(spark, text.year_of_name, ["STU_2018", "x", "", None]) == ["2018", "x", "unknown_year", "unknown_year"]


def test_levels_at_every_cut(spark):
    scores = [358.76, 358.77, 420.07, 482.38, 544.68, 607.04, 669.29, 669.30, None, math.nan]
    expected = ["Below Level 1", "Level 1", "Level 2", "Level 3", "Level 4", "Level 5", "Level 5", "Level 6", None, None]
    assert values(spark, proficiency_level, scores, "double") == expected


def test_headers():
    assert names.clean_header(' Student\'s "age",\n\\x\t') == "Student s age x"
    assert names.unique_names(["a", "A", "a_2", "a", "b"]) == ["a", "A_3", "a_2", "a_4", "b"]


def test_headers_that_need_quoting(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a.b", "c`d", "a.b "])
    cleaned = names.clean_headers(df)
    assert cleaned.columns == ["a.b", "c`d", "a.b_2"]
    assert cleaned.select(*[names.column(c) for c in cleaned.columns]).first() == (1, 2, 3)


def test_role_points():
    assert names.role_points("Plausible Value 1 in Mathematics", names.SCORE_WORDS) == 5
    assert names.role_candidates(["CNTSCHID", "Intl. School ID", "x"], names.SCHOOL_WORDS) == ["Intl. School ID"]
    assert names.role_candidates(["x", "y"], names.SCHOOL_WORDS) == []
    assert names.leveled_score_name(["a", "PV1 MATH_level"], "pv1math") == "PV1 MATH_level"


def test_attribute_column_choice():
    assert names.attribute_column(["Rank", "Score", "Attribute_ID", "Attribute_Name"]) == "Attribute_Name"
    assert names.attribute_column(["rank", "Feature"]) == "Feature"
    assert names.attribute_column(["Rank", "Score", "Thing"]) == "Thing"
    assert names.attribute_column(["Rank"]) == "Rank"


def test_key_choice():
    assert names.merge_key(["a", "b", "c"], ["c", "b"], ["x", "c"]) == "c"
    assert names.merge_key(["a", "b", "c"], ["c", "b"]) == "b"
    assert names.merge_key(["a"], ["b"], ["a"]) is None


def test_unwanted_names():
    columns = ["Final weight", "finale", "Plausible Value 1 in Reading", "PLAUSIBLE VALUE 2 in mathematics", "x", "y", "Plausible Value S"]
    drops = names.unwanted_names(columns, ["y", "absent"], score="Plausible Value S")
    assert drops == ["y", "Final weight", "finale", "Plausible Value 1 in Reading"]
