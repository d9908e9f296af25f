"""Queries that write files derived from the tables and scan them; every table is written by several tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.names import column
from panelwright.plans.changed import prepare_changed
from panelwright.plans.label import load_syntax
from panelwright.plans.prepare import prepare_folder
from panelwright.plans.results import process_results
from panelwright.session import work_folder
from panelwright.sinks.writers import nan_marked, read_stage, write_csv, write_csv_nan_marked
from panelwright.sources.codebook import Layout, decode_table, read_codebook
from panelwright.sources.files import discover, route_files, scan_level
from panelwright.sources.fixed_width import read_fixed_width
from panelwright.sources.model_output import read_rankings, read_selections
from panelwright.sources.quoted_csv import parsed_records, quoted_records
from panelwright.sources.tables import column_list, read_csv, read_csv_folder
from workloads.cells import _customer_lines
from workloads.rankings import FILTERS, METHODS, SCORES_SQL, _ranking_lines
from workloads.registry import named_files, query, spread, table, union_sql
from workloads.tables import SCHOOL, SCORE, STUDENT, _survey_lines, level_sql

TABLES = ("supplier", "part")
# Part files a table is written to.
PARTS = 3


def _text_files(spark: SparkSession, lines: DataFrame, root: str, stem: str, ending: str) -> list[str]:
    """Text files ``stem_0``, ``stem_1``, ... with the rows of a table that holds its rows' order as it is."""
    folder = work_folder(spark, "text")
    lines.write.text(folder)
    return named_files(spark, folder, root, lambda _, k: f"{stem}_{k}{ending}")


def _csv_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with several CSV files per table, and some in a sub-folder of an ignored name."""
    root = work_folder(spark, "csv-files")
    for name, place in (*((t, t) for t in TABLES), ("part", "results/part")):
        folder = write_csv(table(spark, sf_dir, name).repartition(PARTS), work_folder(spark, "csv-parts"))
        named_files(spark, folder, root, lambda _, k, place=place: f"{place}_{k}.CSV")
    return root


def _table_of(file):
    return F.regexp_replace(file, r"_\d+", "")


@query("scan_csv_folder", union_sql([
    "SELECT 'supplier.CSV' AS tab, s_suppkey AS key, s_name AS name FROM supplier",
    "SELECT 'part.CSV', p_partkey, p_name FROM part",
]))
def scan_csv_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every CSV file of a folder as its own table."""
    found = read_csv_folder(spark, _csv_files(spark, sf_dir), encoding="utf-8")
    parts = [df.select(_table_of(F.lit(name)).alias("tab"), F.col(df.columns[0]).alias("key"), F.col(df.columns[1]).alias("name"))
             for name, df in found.items()]
    return reduce(DataFrame.unionByName, parts)


@query("scan_discovered", "SELECT 'supplier.CSV' AS file, count(*) AS n FROM supplier UNION ALL SELECT 'part.CSV', count(*) FROM part")
def scan_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known files below a folder, ignored folders left out, with the lines each table holds in its files."""
    root = _csv_files(spark, sf_dir)
    paths = [r["path"] for r in discover(spark, root).collect()]
    lines = spark.read.text(paths, recursiveFileLookup=True).select(F.col("_metadata.file_name").alias("file"), "value")
    rows = lines.filter(~F.col("value").rlike('^"[a-z]_'))  # not the header of each file
    return rows.groupBy(_table_of(F.col("file")).alias("file")).agg(F.count(F.lit(1)).alias("n"))


@query("scan_level", """
SELECT 'file' AS kind, lower(t) || '.CSV' AS name FROM (VALUES ('supplier'), ('part')) v(t) WHERE EXISTS (SELECT 1 FROM supplier)
""")
def scan_one_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known files and folders just below a folder, the ignored one left out; the files of a table count once."""
    found = scan_level(spark, _csv_files(spark, sf_dir))
    return found.select("kind", _table_of(F.col("name")).alias("name")).distinct()


@query("scan_routed", """
SELECT DISTINCT 'a' || c_nationkey % 4 || '.txt' AS file, CASE WHEN c_nationkey % 2 = 0 THEN 'syntax' ELSE 'skip' END AS format FROM customer
""")
def scan_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files on disk: the first bytes of each tell syntax from other text."""
    root = work_folder(spark, "routed")
    customers = table(spark, sf_dir, "customer")
    for key in range(4):
        mark = F.lit(" data list file ") if key % 2 == 0 else F.lit(" ")
        lines = customers.filter(F.col("c_nationkey") % 4 == key).select(F.concat(F.lit("* "), "c_name", mark))
        _text_files(spark, lines.repartition(PARTS), root, f"a{key}", ".txt")
    routed = route_files(spark, root)
    return routed.select(_table_of(F.element_at(F.split("path", "/"), -1)).alias("file"), "format").distinct()


@query("csv_quoted_splits", "SELECT doc_id, md5(coalesce(text, '')) AS digest, length(coalesce(text, '')) AS n FROM documents")
def csv_quoted_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with their line breaks and quotes in CSV files that several tasks read each."""
    path = write_csv(table(spark, sf_dir, "documents").select("doc_id", "text"), work_folder(spark, "csv-documents"))
    rows = parsed_records(quoted_records(spark, path), column_list(spark, path, "utf-8"), "UTF-8")
    text = F.coalesce("text", F.lit(""))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("digest"), F.length(text).cast("long").alias("n"))


@query("scan_syntax", """
SELECT 'variable' AS kind, 'V' || p_partkey AS name, p_size || '-' || (p_size + 3) AS code, p_name AS label FROM part
UNION ALL SELECT 'value', 'V' || p_partkey, '1', p_brand FROM part
UNION ALL SELECT 'value', 'V' || p_partkey, '2', p_type FROM part
UNION ALL SELECT 'value', 'V' || p_partkey, '99', 'Missing' FROM part
""")
def scan_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syntax files on disk whose sections may reach over the splits of a file."""
    name = F.concat(F.lit("V"), F.col("p_partkey").cast("string"))
    size = F.col("p_size").cast("long")
    lines = [
        F.lit("* Two lines that are skipped"), F.lit("* in the first unit of a file."),
        F.concat(F.lit("  "), F.lower(name), F.lit("  "), size.cast("string"), F.lit(" - "), (size + 3).cast("string"), F.lit(" (F,0)")),
        F.concat(name, F.lit(' "'), F.col("p_name"), F.lit('"')), F.concat(F.lit("Missing values "), name, F.lit(" (99).")),
        F.lit("value labels"), F.concat(F.lit("/"), name), F.concat(F.lit('1 "'), F.col("p_brand"), F.lit('"')),
        F.concat(F.lit("2 '"), F.col("p_type"), F.lit("'")), F.lit("."), F.lit('3 "outside"'),
    ]
    units = table(spark, sf_dir, "part").repartition(PARTS).select(F.concat_ws("\n", *lines).alias("value"))
    root = work_folder(spark, "syntax")
    _text_files(spark, units, root, "part", ".sps")
    book = read_codebook(spark, root)
    variables = book.variables.select(
        F.lit("variable").alias("kind"), "name", F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")).alias("code"), "label")
    return variables.unionByName(decode_table(book).select(F.lit("value").alias("kind"), "name", "code", "label"))


@query("scan_fixed_width", """
SELECT CAST(c_custkey AS VARCHAR) AS "KEY", nullif(c_mktsegment, 'FURNITURE') AS "SEGMENT", c_name AS "NAME" FROM customer
""")
def scan_fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width text on disk, cut into columns."""
    layout = Layout(["KEY", "SEGMENT", "NAME"], [1, 13, 25], [12, 24, 48], [None, None, None])
    root = work_folder(spark, "fixed-width")
    _text_files(spark, _customer_lines(spark, sf_dir).repartition(PARTS), root, "customer", ".txt")
    return read_fixed_width(spark, root, layout)


SURVEY_SYNTAX = f"""* Survey of the orders.
DATA LIST FILE "C:\\data\\students.dat"
CNT       1 - 3    (A)
SCHOOLID  4 - 15   (A)
STUDENTID 16 - 27  (A)
ST01      28 - 28  (F,0)
W_FSTUWT  29 - 32  (F,2)
PV1MATH   33 - 52  (F,2)
VARIABLE LABELS
CNT "Country"
SCHOOLID "{SCHOOL}"
STUDENTID "{STUDENT}"
ST01 "Status"
W_FSTUWT "Final student weight"
PV1MATH "{SCORE}"
Missing values ST01 (9).
value labels
/ST01
1 "Finished"
2 "Open"
.
"""


def _survey_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a syntax file and the fixed-width text it names, which lies in several files."""
    root = work_folder(spark, "survey")
    _survey_lines(spark, sf_dir).repartition(PARTS).write.text(f"{root}/students.dat")
    syntax = table(spark, sf_dir, "region").limit(1).select(F.lit(SURVEY_SYNTAX).alias("value"))  # one row
    _text_files(spark, syntax.coalesce(1), root, "students", ".sps")
    return root


@query("load_survey_files", f"""
SELECT 'MEX' AS "Country", CAST(o_custkey AS VARCHAR) AS "{SCHOOL}", CAST(o_orderkey AS VARCHAR) AS "{STUDENT}",
       CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE 'Missing' END AS "Status",
       '1.0' AS "Final student weight", CAST(CAST(o_totalprice AS DECIMAL(14, 2)) AS VARCHAR) AS "{SCORE}"
FROM orders WHERE o_orderpriority <> '1-URGENT'
""")
def load_survey_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syntax file and fixed-width text on disk to the labeled rows of one country."""
    root = _survey_files(spark, sf_dir)
    return load_syntax(spark, f"{root}/students_0.sps", root, "MEX")[0]


@query("prepare_survey_folder", f"""
SELECT o_custkey AS "{SCHOOL}", o_orderkey AS "{STUDENT}", CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' END AS "Status",
       CASE WHEN o_totalprice > 9990 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(14, 2))::DOUBLE END AS "{SCORE}",
       {level_sql('CASE WHEN o_totalprice > 9990 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(14, 2))::DOUBLE END')} AS "{SCORE}_level"
FROM orders WHERE o_orderpriority <> '1-URGENT'
""")
def prepare_survey_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from a folder on disk; the leveled table is read back."""
    root = _survey_files(spark, sf_dir)
    written, failed = prepare_folder(spark, root, "MEX")
    if failed:
        raise ValueError(f"{failed}")
    return read_stage(spark, root, "leveled", written[0])


@query("prepare_changed_folder", f"""
SELECT CAST(4 AS INT) AS first_run, CAST(0 AS INT) AS second_run, o_custkey AS "{SCHOOL}", o_orderkey AS "{STUDENT}",
       CASE WHEN o_totalprice > 9990 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(14, 2))::DOUBLE END AS "{SCORE}"
FROM orders WHERE o_orderpriority <> '1-URGENT'
""")
def prepare_changed_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of a folder twice: the second run finds nothing to write and leaves the tables of the first."""
    root = _survey_files(spark, sf_dir)
    first, second = (prepare_changed(spark, root, "MEX", save_unlabeled=True) for _ in range(2))
    leveled = read_stage(spark, root, "leveled", second.tables[0])
    return leveled.select(F.lit(len(first.written)).alias("first_run"), F.lit(len(second.written)).alias("second_run"), *[column(c) for c in (SCHOOL, STUDENT, SCORE)])


@query("unlabeled_side_output", """
SELECT 'MEX' AS "CNT", CAST(o_custkey AS VARCHAR) AS "SCHOOLID", CAST(o_orderkey AS VARCHAR) AS "STUDENTID",
       CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE '9' END AS "ST01", '1.0' AS "W_FSTUWT",
       CAST(CAST(o_totalprice AS DECIMAL(14, 2)) AS VARCHAR) AS "PV1MATH"
FROM orders WHERE o_orderpriority <> '1-URGENT'
""")
def unlabeled_side_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw rows that the preparation writes next to the labeled ones."""
    root = _survey_files(spark, sf_dir)
    prepare_folder(spark, root, "MEX", save_unlabeled=True)
    return read_stage(spark, root, "labeled", "students_0_unlabeled")


@query("process_result_files", f"""
WITH {SCORES_SQL}
SELECT result_name, rank AS "Rank", round(score, 4) AS "Score", attribute_id AS "Attribute_ID", attribute AS "Attribute_Name" FROM ranked WHERE rank <= 20
""")
def process_result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranker and selector files of every brand on disk to the top list of each brand."""
    root, lines = work_folder(spark, "model-output"), work_folder(spark, "text")
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    block = F.concat(
        F.lit("=== Run ===\n\nSelected attributes: "), key, F.lit(" : 1\n      attr "), key,
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("\r\n   attr "), (F.col("p_partkey") + 1).cast("string"))).otherwise(""),
        F.lit("\n\n not a name\n"))
    kind = F.when(F.col("p_size") > 25, "Wrapper").otherwise("subset")
    selected = spread(part).select(F.concat("p_brand", F.lit("_"), kind, F.lit(".txt")).alias("file"), block.alias("value"))
    ranked = _ranking_lines(spark, sf_dir).select("file", F.col("line").alias("value"))
    # A ranker's scores are set against the best of their file, so a file is written by one task, and all files side by side.
    ranked.unionByName(selected).repartition("file").write.partitionBy("file").text(lines)
    named_files(spark, lines, root, lambda folder, k: folder.removeprefix("file=").replace("%23", "#"))
    # A file counts for every context that its name contains, so the contexts end where the brand does.
    brands = [r["p_brand"] + "_" for r in part.select("p_brand").distinct().collect()]
    results = process_results(spark, root, part, brands, ranking_filters=METHODS, selection_filters=FILTERS)
    return results.summary.withColumn("result_name", F.rtrim(F.col("result_name"), F.lit("_")))


@query("sink_nan_marked", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, coalesce(nullif(p_brand, 'Brand#11'), 'nan') AS p_brand, coalesce(CAST(nullif(p_size, 7) AS VARCHAR), 'nan') AS p_size FROM part
""")
def sink_nan_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nan-marked CSV as it lies on disk."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.nullif("p_brand", F.lit("Brand#11")).alias("p_brand"), F.nullif("p_size", F.lit(7)).alias("p_size"))
    path = write_csv_nan_marked(part, work_folder(spark, "nan"))
    return spark.read.csv(path, header=True, schema=nan_marked(part).schema)


@query("scan_rankings", """
SELECT c_mktsegment AS result_name, CAST(c_custkey % 100 AS DOUBLE) / 4 AS score, c_custkey AS number, 'attr ' || c_custkey AS attribute
FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
""")
def scan_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranker files on disk, told apart by name; files of other segments and methods are not read."""
    root = work_folder(spark, "rankings")
    customer = table(spark, sf_dir, "customer")
    lines = customer.select("c_mktsegment", F.concat(
        F.lit(" "), (F.col("c_custkey") % 100 / 4).cast("string"), F.lit("   "), F.col("c_custkey").cast("string"),
        F.lit(" attr "), F.col("c_custkey").cast("string")).alias("value"))
    for ending in ("CORR.txt", "gain", "other.txt"):
        folder = work_folder(spark, "text")
        lines.repartition(PARTS).write.partitionBy("c_mktsegment").text(folder)
        # Odd segments have their files from one ranker, the others from another one; all have files of an unknown one.
        kept = {"CORR.txt": ("BUILDING", "FURNITURE"), "gain": ("MACHINERY", "HOUSEHOLD", "AUTOMOBILE")}.get(ending)
        named_files(spark, folder, root, lambda inner, k: (
            f"{inner.removeprefix('c_mktsegment=')}_{k}_{ending}" if kept is None or inner.removeprefix("c_mktsegment=") in kept
            else f"unused/{inner}_{k}"))
    return read_rankings(spark, root, ["BUILDING", "MACHINERY"]).select("result_name", "score", "number", "attribute")


@query("scan_selections", """
SELECT 'ASIA' AS result_name, 'wrapper' AS filter, s_name AS attribute, s_suppkey AS attribute_id FROM supplier
""")
def scan_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selector files on disk with blocks of fifty suppliers: the ids of a block's first line belong to the names below."""
    root = work_folder(spark, "selections")
    blocks = table(spark, sf_dir, "supplier").groupBy(F.expr("s_suppkey div 50").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("rows"))
    ids = F.array_join(F.transform("rows", lambda r: r["s_suppkey"].cast("string")), ",")
    names = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("\n      "), r["s_name"])), "")
    text = F.concat(F.lit("Selected attributes: "), ids, F.lit(" : "), F.size("rows").cast("string"), names, F.lit("\n"))
    _text_files(spark, blocks.select(text.alias("value")).repartition(PARTS), root, "asia_Wrapper", ".txt")
    return read_selections(spark, root, ["ASIA"]).select("result_name", "filter", "attribute", "attribute_id")
