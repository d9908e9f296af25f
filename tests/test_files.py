import pytest
from pyspark.sql import functions as F

from panelwright.plans.label import load_syntax, load_table, write_labeled
from panelwright.plans.prepare import label_folder, prepare_folder
from panelwright.sinks import writers
from panelwright.sinks.writers import write_csv
from panelwright.sources.codebook import decode_table, layout_of, parse_codebook, read_syntax
from panelwright.sources.files import discover, route_files, scan_level
from panelwright.sources.tables import (
    column_list,
    pick_column,
    preview,
    read_column,
    read_csv,
    read_csv_folder,
    read_parquet_tables,
    rows_of_country,
)

SYNTAX = """* header line.
DATA LIST FILE "C:\\data\\stu.txt"
CNT       1 - 3   (A)
SCHOOLID  4 - 8   (A)
st03q01   9 - 9   (F,0)
ST04Q01   10 - 11 (F,2)
VARIABLE LABELS
CNT      "Country code"
ST03Q01  "Sex"
SCHOOLID "Sex"
Missing values ST03Q01 (8,9).
Missing values NOBODY (1).
value labels
/ST03Q01 NOBODY
1 "Female"
2 'Male é'
8 "Not 'reached'"
/ST04Q01/
01 "one word"
02 two

.
3 "outside"
value labels
4 "goes to the last names"
/CNT
MEX "Mexico"
.
"""
DATA = "MEX000011 1\nMEX000029  \nMEX00003802\nUSA00001201\nmex000021\n"


@pytest.fixture
def survey(tmp_path):
    (tmp_path / "stu.sps").write_bytes(SYNTAX.replace("\n", "\r\n").encode("cp1252"))
    (tmp_path / "stu.txt").write_bytes((DATA + "MEXé€  1\n").encode("cp1252"))
    return tmp_path


def test_codebook(spark, survey, rows):
    book = parse_codebook(read_syntax(spark, str(survey / "stu.sps")))
    assert book.data_files.first()["data_file"] == "stu.txt"
    file = book.data_files.first()["file"]
    assert rows(book.variables, "name", "start", "end", "fmt", "label") == [
        ("CNT", 1, 3, "(A)", "Country code"), ("SCHOOLID", 4, 8, "(A)", "Sex"),
        ("ST03Q01", 9, 9, "(F,0)", "Sex"), ("ST04Q01", 10, 11, "(F,2)", None)]
    assert layout_of(book, file).names == ["CNT", "SCHOOLID", "ST03Q01", "ST04Q01"]
    assert rows(book.value_labels, "name", "code", "label") == [
        ("CNT", "MEX", "Mexico"), ("ST03Q01", "1", "Female"), ("ST03Q01", "2", "Male é"), ("ST03Q01", "8", "Not reached"),
        ("ST04Q01", "01", "one word"), ("ST04Q01", "02", "two"), ("ST04Q01", "4", "goes to the last names")]
    assert rows(book.missing_codes, "name", "code") == [("ST03Q01", "8"), ("ST03Q01", "9")]
    assert ("ST03Q01", "9", "Missing") in rows(decode_table(book), "name", "code", "label")
    assert ("ST03Q01", "8", "Not reached") in rows(decode_table(book), "name", "code", "label")


def test_last_definition_wins_over_many_files(spark, rows):
    text = "x\ny\nA 1 - 2 (A)\nB 3 - 4 (A)\nA 5 - 6 (F,1)\nA \"first\"\nA \"second\"\nvalue labels\n/A\n1 a\n1 b\n.\nvalue labels\n/A\n1 c\n."
    files = spark.createDataFrame([(f"f{k}", text) for k in range(3)], "file string, text string")
    book = parse_codebook(files)
    assert rows(book.variables.filter("file = 'f1'"), "name", "start", "fmt", "label") == [("A", 5, "(F,1)", "second"), ("B", 3, "(A)", None)]
    assert rows(book.value_labels, "file", "code", "label") == [("f0", "1", "c"), ("f1", "1", "c"), ("f2", "1", "c")]
    assert layout_of(book, "f1").names == ["A", "B"]
    assert book.data_files.filter("data_file is not null").count() == 0


def test_fixed_width_file_to_labeled_table(spark, survey, rows):
    labeled, raw = load_syntax(spark, str(survey / "stu.sps"), str(survey), "MEX")
    assert labeled.columns == ["Country code", "Sex", "Sex_2", "ST04Q01"]
    assert rows(raw) == [("MEX", "00001", "1", "1"), ("MEX", "00002", "9", None), ("MEX", "00003", "8", "02"), ("MEX", "é€  1", None, None)]
    assert rows(labeled) == [("Mexico", "00001", "Female", "1"), ("Mexico", "00002", "Missing", None),
                             ("Mexico", "00003", "Not reached", "two"), ("Mexico", "é€  1", None, None)]
    everything = load_syntax(spark, str(survey / "stu.sps"), str(survey))[1]
    assert everything.count() == 6


def test_table_with_codebook_and_raw_copy(spark, survey, tmp_path):
    book = parse_codebook(read_syntax(spark, str(survey / "stu.sps")))
    file = book.data_files.first()["file"]
    table = spark.createDataFrame([("Mex", 1), ("USA", 2), ("mex", 2), (None, 1)], "CNT string, ST03Q01 int")
    labeled, raw = load_table(table, book, file, "mex")
    assert sorted(r["Sex"] for r in labeled.collect()) == ["Female", "Male é"]
    path = write_labeled(labeled, raw, str(tmp_path / "root"), "stu", save_unlabeled=True)
    assert path.endswith("labeled/stu")
    assert spark.read.parquet(path + "_unlabeled").count() == 2


def test_csv_reading(spark, tmp_path, rows):
    content = 'id,näme €,note,"odd,name",all\n1,"a ""q"", b","two\nlines",1.5,NA\nN/A,é,Missing,NULL,\n3,x,,2e1,nan\n'
    (tmp_path / "t.csv").write_bytes(content.encode("cp1252"))
    df = read_csv(spark, str(tmp_path / "t.csv"))
    assert df.dtypes == [("id", "bigint"), ("näme €", "string"), ("note", "string"), ("odd,name", "double"), ("all", "double")]
    assert rows(df) == [(None, "é", "Missing", None, None), (1.0, 'a "q", b', "two\nlines", 1.5, None), (3.0, "x", None, 20.0, None)]
    assert column_list(spark, str(tmp_path / "t.csv")) == df.columns
    assert read_column(spark, str(tmp_path / "t.csv"), "nothing") is None
    assert [r[0] for r in read_column(spark, str(tmp_path / "t.csv"), "näme €").collect()] == ['a "q", b', "é", "x"]
    assert pick_column(df, "zz") is None and pick_column(df, "id").columns == ["id"]
    assert preview(df, 2).count() == 2
    assert rows_of_country(df, None).count() == 3


def test_csv_folder(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x\n1\n")
    (tmp_path / "a.csv").write_text("y,z\n1,k\n")
    (tmp_path / "note.txt").write_text("no table")
    tables = read_csv_folder(spark, str(tmp_path))
    assert {n: df.columns for n, df in tables.items()} == {"a.csv": ["y", "z"], "b.csv": ["x"]}
    assert list(tables) == ["a.csv", "b.csv"]


@pytest.mark.parametrize("encoding", ["utf-8", "cp1252"])
def test_csv_sink_round_trip(spark, tmp_path, encoding):
    data = [('q "x", y', None, 1.5), ("line\nbreak €", "", None), ("back\\slash", "é", -2.0)]
    df = spark.createDataFrame(data, "a string, b string, c double")
    path = writers.write_csv(df, str(tmp_path / "out"), encoding)
    back = read_csv(spark, path, encoding=encoding)
    assert sorted(map(tuple, back.collect()), key=str) == sorted([(a, b or None, c) for a, b, c in data], key=str)
    raw = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("*.csv"))
    assert b'"line\nbreak ' + "€".encode(encoding) + b'"' in raw and b'""x""' in raw


def test_nan_marked_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (None, "x")], "a int, b string")
    path = writers.write_csv_nan_marked(df, str(tmp_path / "w"))
    lines = sorted(l for p in (tmp_path / "w").glob("*.csv") for l in p.read_text().splitlines()[1:])
    assert lines == ['"1","nan"', '"nan","x"'] and path


def test_discovery(spark, tmp_path):
    for name in ("a.CSV", "deep/b.sav", "deep/c.pdf", "results/d.csv", "deep/.git/e.txt", "Resultados/f.csv", "deep/g.sps"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("data list" if name.endswith("x") else "content")
    (tmp_path / "syntax.txt").write_text("x\ndata LIST file\n")
    (tmp_path / "late.TXT").write_text("x" * 2048 + "DATA LIST")
    found = [r["path"].split(str(tmp_path))[1] for r in discover(spark, str(tmp_path)).collect()]
    assert found == ["/a.CSV", "/deep/b.sav", "/deep/g.sps", "/late.TXT", "/syntax.txt"]
    routed = {r["path"].split(str(tmp_path))[1]: r["format"] for r in route_files(spark, str(tmp_path)).collect()}
    assert routed == {"/a.CSV": "csv", "/deep/b.sav": "table", "/deep/g.sps": "syntax", "/late.TXT": "skip", "/syntax.txt": "syntax"}
    level = [tuple(r) for r in scan_level(spark, str(tmp_path)).collect()]
    assert level == [("file", "a.CSV"), ("file", "late.TXT"), ("file", "syntax.txt"), ("folder", "deep")]


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    plan = discover(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan


def test_stage_paths(spark, tmp_path):
    assert writers.stage_root("/x/labeled/") == "/x" and writers.stage_root("/x/other") == "/x/other"
    path = writers.write_stage(spark.range(2).select(F.col("id").cast("string")), str(tmp_path), "cleaned", "t", csv=True)
    assert read_csv(spark, path).count() == 2


def test_top_by_year(spark, tmp_path):
    overall = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "Rank int, name string")
    data = spark.createDataFrame([(1, 5, 6)], "ID int, MATH int, x int")
    paths = writers.write_top_by_year(overall, data, str(tmp_path), 2, None, ["ID"], ["MATH"])
    assert sorted(r["name"] for r in spark.read.parquet(paths["top"]).collect()) == ["a", "b"]
    assert spark.read.parquet(paths["ids"]).first().asDict() == {"ID": 1, "MATH": 5, "year": "unknown_year"}
    with pytest.raises(ValueError):
        writers.write_top_by_year(overall, data, str(tmp_path), 2, "A_2018", ["ID"], ["NONE"])


def test_parquet_tables_have_one_missing_marker(spark, tmp_path):
    spark.createDataFrame([(float("nan"),), (1.0,)], "d double").write.parquet(str(tmp_path / "p"))
    tables = read_parquet_tables(spark, {"p": str(tmp_path / "p")})
    assert sorted((r["d"] for r in tables["p"].collect()), key=str) == [1.0, None]


def test_folder_of_files_to_leveled_tables(spark, tmp_path):
    pv = "Plausible Value 1 in Mathematics"
    syntax = f"""* x.
DATA LIST FILE "c:\\d\\stu.txt"
CNT 1 - 3 (A)
SCH 4 - 5 (A)
STU 6 - 7 (A)
PV1 8 - 12 (F,1)
VARIABLE LABELS
SCH "School ID"
STU "Student ID"
PV1 "{pv}"
"""
    (tmp_path / "stu.sps").write_text(syntax)
    (tmp_path / "stu.txt").write_text("MEX 1 1400.0\nMEX 1 2 700\nUSA 1 3 1.0\nMEX 2 4 358\n")
    (tmp_path / "sch.csv").write_text("School ID,size\n1,10\n2,20\n")
    (tmp_path / "broken.sps").write_text("a\nb\n")
    (tmp_path / "other.sav").write_bytes(b"x")
    (tmp_path / "labeled").mkdir()
    (tmp_path / "labeled" / "old.csv").write_text("a\n1\n")
    labeled = label_folder(spark, str(tmp_path), "MEX")
    assert sorted(labeled.tables) == ["sch", "stu"] and sorted(f.rsplit("/", 1)[1] for f in labeled.failed) == ["broken.sps", "other.sav"]
    names, failed = prepare_folder(spark, str(tmp_path), "MEX", save_unlabeled=True)
    assert sorted(names) == ["full_merged", "sch", "stu"] and len(failed) == 2
    final = spark.read.parquet(str(tmp_path / "leveled" / "full_merged")).orderBy("Student ID").collect()
    assert [(r["Student ID"], r["size"], r[f"{pv}_level"]) for r in final] == [(1.0, 10.0, "Level 1"), (2.0, 10.0, "Level 6"), (4.0, 20.0, "Below Level 1")]
    assert spark.read.parquet(str(tmp_path / "labeled" / "stu_unlabeled")).columns == ["CNT", "SCH", "STU", "PV1"]


def test_code_page_headers_and_faults(spark, tmp_path):
    df = spark.createDataFrame([("é €",)], "`Student’s – €` string")
    write_csv(df, str(tmp_path / "page"), encoding="cp1252")
    assert read_csv(spark, str(tmp_path / "page")).columns == ["Student’s – €"]
    far = spark.createDataFrame([("漢",)], "a string")
    with pytest.raises(Exception, match="outside code page 1252"):
        write_csv(far, str(tmp_path / "far"), encoding="cp1252")
    write_csv(far, str(tmp_path / "far"), encoding="cp1252", errors="replace")
    assert read_csv(spark, str(tmp_path / "far")).first()["a"] == "?"
    with pytest.raises(ValueError, match="column names"):
        write_csv(far.withColumnRenamed("a", "漢"), str(tmp_path / "name"), encoding="cp1252")


def test_files_of_one_name(spark, tmp_path):
    for year in ("2018", "2022"):
        (tmp_path / year).mkdir()
        (tmp_path / year / "stu.csv").write_text(f"a\n{year}\n")
    (tmp_path / "2018" / "stu.sps").write_text("a\nb\n")
    found = label_folder(spark, str(tmp_path))
    assert {n: df.first()["a"] for n, df in found.tables.items()} == {"2018/stu": 2018, "2022/stu": 2022}
    assert len(found.failed) == 1
