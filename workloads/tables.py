"""Queries on whole tables: joins, column sets, roles, files, written stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.levels import LEVEL_CUTS
from panelwright.operators.columns import add_level, drop_unwanted, select_required, split_columns
from panelwright.operators.joins import left_join, membership, star_join
from panelwright.operators.roles import Roles, best_roles, detect_roles
from panelwright.plans.clean import clean
from panelwright.plans.label import label_table
from panelwright.plans.prepare import Thresholds, label_folder, prepare
from panelwright.plans.transform import transform
from panelwright.session import work_folder
from panelwright.sinks.versions import commit_restored, drop_columns_versioned, read_version, write_version
from panelwright.sinks.writers import read_stage, write_csv, write_top_by_year
from panelwright.sources.codebook import Codebook
from panelwright.sources.files import file_format, wanted_paths
from panelwright.sources.fixed_width import cut_lines
from panelwright.sources.codebook import Layout
from panelwright.sources.tables import column_list, read_column, read_csv
from workloads.registry import named_files, query, table, union_sql
from workloads.statistics import JOINED_DOCS, labelled_documents

SCORE = "Plausible Value 1 in Mathematics"
SCHOOL, STUDENT = "Intl. School ID", "Intl. Student ID"


# The same cut points for scores that are 500 times as large.
LARGE_CUTS = [(cut * 500, name) for cut, name in LEVEL_CUTS]


def level_sql(expression: str, cuts=LEVEL_CUTS) -> str:
    steps = " ".join(f"WHEN {expression} >= {cut!r} THEN '{name}'" for cut, name in cuts)
    return f"CASE WHEN {expression} IS NULL THEN NULL {steps} ELSE 'Below Level 1' END"


@query("level_counts", f"""
SELECT {level_sql('o_totalprice / 500')} AS score_level, c_mktsegment, count(*) AS n
FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
""")
def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), (F.col("o_totalprice") / 500).alias("score"))
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "custkey")
    leveled = add_level(left_join(scores, customers.select("custkey", "c_mktsegment"), "custkey"), "score")
    return leveled.groupBy("score_level", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("left_join_dup", f"""
SELECT o_orderkey, o_custkey AS custkey, o_orderstatus AS status, c_name AS name, c_acctbal AS balance,
       o_totalprice AS "{SCORE}"
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def left_join_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right table's status clashes with the left one, also in another letter case; the left stays."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_totalprice").alias(SCORE), "o_orderkey", F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status")
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("STATUS"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")
    )
    return left_join(orders, customers, "custkey")


@query("null_safe_join", """
WITH p AS (SELECT p_partkey, nullif(p_brand, 'Brand#13') AS brand FROM part),
b AS (SELECT brand, count(*) AS n FROM p GROUP BY brand)
SELECT p_partkey, p.brand, n FROM p LEFT JOIN b ON p.brand IS NOT DISTINCT FROM b.brand
""")
def null_safe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#13")).alias("brand"))
    sizes = parts.groupBy("brand").agg(F.count(F.lit(1)).alias("n"))
    return left_join(parts, sizes, "brand", null_safe=True)


@query("null_key_join", """
WITH p AS (SELECT p_partkey, nullif(p_brand, 'Brand#13') AS brand FROM part),
b AS (SELECT brand, count(*) AS n FROM p GROUP BY brand)
SELECT p_partkey, p.brand, n FROM p LEFT JOIN b ON p.brand = b.brand
""")
def null_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#13")).alias("brand"))
    sizes = parts.groupBy("brand").agg(F.count(F.lit(1)).alias("n"))
    return left_join(parts, sizes, "brand")


def _star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"),
        "l_linenumber", (F.col("l_extendedprice") / 120).alias("score"),
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_orderpriority", "o_orderstatus")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), "p_brand", "p_size")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("suppkey"), "s_nationkey", "s_acctbal")
    lonely = table(spark, sf_dir, "region")
    return {"items": items, "orders": orders, "parts": parts, "suppliers": suppliers, "lonely": lonely}


@query("star_join", """
SELECT l_orderkey AS orderkey, l_partkey AS partkey, l_suppkey AS suppkey, l_linenumber, round(l_extendedprice / 120, 6) AS score,
       o_orderpriority, o_orderstatus, p_brand, p_size, s_nationkey, s_acctbal
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
LEFT JOIN supplier ON l_suppkey = s_suppkey
""")
def star_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = star_join(_star(spark, sf_dir), "score", ["orderkey", "partkey", "suppkey"])["full_merged"]
    return merged.withColumn("score", F.round("score", 6))


@query("star_pairs", union_sql([
    "SELECT 'orders' AS tab, count(*) AS n, count(o_orderstatus) AS hits FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey",
    "SELECT 'parts', count(*), count(p_brand) FROM lineitem LEFT JOIN part ON l_partkey = p_partkey",
    "SELECT 'suppliers', count(*), count(s_acctbal) FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey",
]))
def star_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = star_join(_star(spark, sf_dir), "score")
    hits = {"orders": "o_orderstatus", "parts": "p_brand", "suppliers": "s_acctbal"}
    parts = [joined[t].agg(F.lit(t).alias("tab"), F.count(F.lit(1)).alias("n"), F.count(c).alias("hits")) for t, c in hits.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("membership_flag", """
SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good FROM documents
""")
def membership_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return membership(table(spark, sf_dir, "documents").select("doc_id"), good, ["doc_id"], "good")


@query("drop_unwanted", f"""
SELECT o_orderkey, o_totalprice AS "{SCORE}", o_custkey AS "plausible value 10 IN mathematics" FROM orders
""")
def drop_unwanted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("Final student weight"), F.col("o_totalprice").alias(SCORE),
        F.col("o_totalprice").alias("Plausible Value 1 in Reading"), F.col("o_custkey").alias("plausible value 10 IN mathematics"),
        "o_orderpriority",
    )
    return drop_unwanted(orders, ["o_orderpriority", "absent"], score=SCORE)[0]


SPLIT = [(0, 3), (6, 8)]


@query("split_in", "SELECT l_orderkey, l_partkey, l_suppkey, l_discount, l_tax FROM lineitem")
def split_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_columns(table(spark, sf_dir, "lineitem"), SPLIT, ["l_orderkey", "absent"])[0]


@query("split_out", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def split_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_columns(table(spark, sf_dir, "lineitem"), SPLIT, ["l_orderkey", "absent"])[1]


def _students(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias(SCHOOL), F.col("o_orderkey").alias(STUDENT),
        F.col("o_orderstatus").alias("Student ID kind"), (F.col("o_totalprice") / 500).alias(SCORE),
        F.round(F.col("o_totalprice") / 50000).alias("Plausible Value 2 in Mathematics"),
    )


def _schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(SCHOOL), F.col("c_mktsegment").alias("School type"), F.col("c_acctbal").alias("School size")
    )


@query("detect_roles", f"""
SELECT CASE WHEN count(DISTINCT o_totalprice / 500) >= count(DISTINCT round(o_totalprice / 50000)) THEN '{SCORE}'
            ELSE 'Plausible Value 2 in Mathematics' END AS score,
       '{SCHOOL}' AS school,
       CASE WHEN count(DISTINCT o_orderkey) >= count(DISTINCT o_orderstatus) THEN '{STUDENT}' ELSE 'Student ID kind' END AS student,
       CASE WHEN count(*) > 0 THEN '{SCORE}_level' END AS leveled_score
FROM orders
""")
def detect_roles_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    students = add_level(_students(spark, sf_dir), SCORE)
    return spark.createDataFrame([detect_roles(students)], "score string, school string, student string, leveled_score string")


@query("best_roles", f"""
SELECT '{SCORE}' AS score, CASE WHEN (SELECT count(DISTINCT c_custkey) FROM customer) > (SELECT count(DISTINCT o_custkey) FROM orders)
       THEN 'School id' ELSE '{SCHOOL}' END AS school, '{STUDENT}' AS student
""")
def best_roles_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    schools = _schools(spark, sf_dir).withColumnRenamed(SCHOOL, "School id")
    roles = best_roles({"student": _students(spark, sf_dir), "school": schools, "item": table(spark, sf_dir, "lineitem")}, Roles(score=SCORE))
    return spark.createDataFrame([roles[:3]], "score string, school string, student string")


@query("discover_files", """
SELECT DISTINCT '/data/'||source||'/'||lang||doc_id||CASE lang WHEN 'en' THEN '.CSV' WHEN 'de' THEN '.sav' WHEN 'fr' THEN '.pdf' ELSE '.txt' END AS path
FROM documents WHERE source <> 'src1' AND lang <> 'fr'
""")
def discover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a file listing: one source is an ignored folder, one language an unknown extension."""
    return wanted_paths(_document_paths(spark, sf_dir))


def _document_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("source") == "src1", "Results").otherwise(F.col("source"))
    ending = F.when(F.col("lang") == "en", ".CSV").when(F.col("lang") == "de", ".sav").when(F.col("lang") == "fr", ".pdf").otherwise(".txt")
    path = F.concat(F.lit("/data/"), folder, F.lit("/"), "lang", F.col("doc_id").cast("string"), ending)
    return table(spark, sf_dir, "documents").select(path.alias("path"), "text")


@query("route_files", """
SELECT '/data/'||CASE WHEN source = 'src1' THEN 'Results' ELSE source END||'/'||lang||doc_id||
         CASE lang WHEN 'en' THEN '.CSV' WHEN 'de' THEN '.sav' WHEN 'fr' THEN '.pdf' ELSE '.txt' END AS path,
       CASE lang WHEN 'en' THEN 'csv' WHEN 'de' THEN 'table' WHEN 'fr' THEN 'table'
            ELSE CASE WHEN contains(upper(substr(replace(text, 'en', 'data list'), 1, 2048)), 'DATA LIST')
                        OR contains(upper(substr(replace(text, 'en', 'data list'), 1, 2048)), 'VARIABLE LABELS')
                 THEN 'syntax' ELSE 'skip' END END AS format
FROM documents
""")
def route_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format by extension, and by the marks in the head of a text file (the sniffed head is the operator)."""
    files = _document_paths(spark, sf_dir).withColumn("text", F.replace("text", F.lit("en"), F.lit("data list")))
    return files.select("path", file_format(F.col("path"), F.col("text")).alias("format"))


@query("csv_round_trip", """
SELECT conv_id, turn, role, text FROM conversations
""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks, quotes and accents through a quoted CSV folder and back."""
    path = write_csv(table(spark, sf_dir, "conversations"), work_folder(spark, "csv"))
    return read_csv(spark, path, encoding="utf-8")


@query("csv_code_page", """
SELECT p_partkey AS "Schlüssel ’ €", p_name||' – “é€”' AS name, CAST(nullif(p_size, 7) AS BIGINT) AS size FROM part
""")
def csv_code_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code page 1252 written and read, with characters outside Latin-1 and missing values."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("Schlüssel ’ €"), F.concat("p_name", F.lit(" – “é€”")).alias("name"), F.nullif("p_size", F.lit(7)).alias("size")
    )
    path = write_csv(part, work_folder(spark, "cp1252"), encoding="cp1252")
    return read_csv(spark, path)


@query("csv_single_column", "SELECT p_name, 'p_partkey p_name p_brand p_type p_size p_retailprice' AS header FROM part")
def csv_single_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_csv(table(spark, sf_dir, "part"), work_folder(spark, "column"))
    header = " ".join(column_list(spark, path))
    return read_column(spark, path, "p_name").withColumn("header", F.lit(header))


@query("restore_version", "SELECT 'dropped' AS state, c_custkey, c_name, NULL AS c_acctbal FROM customer UNION ALL SELECT 'restored', c_custkey, c_name, c_acctbal FROM customer")
def restore_version_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "versions")
    write_version(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    latest = drop_columns_versioned(spark, path, 0, ["c_acctbal", "absent"])
    dropped = read_version(spark, path, latest).withColumn("c_acctbal", F.lit(None).cast("double"))
    restored = read_version(spark, path, commit_restored(spark, path, 0))
    return dropped.withColumn("state", F.lit("dropped")).unionByName(restored.withColumn("state", F.lit("restored")))


@query("required_columns", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_required(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_quantity"])


@query("top_by_year", """
SELECT 'top' AS part, '2018' AS year, p_partkey, -CAST(round(p_retailprice * 100) AS BIGINT) * 1000000 - p_partkey AS place, NULL AS p_size
FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 5)
UNION ALL SELECT 'ids', '2018', p_partkey, NULL, p_size FROM part
""")
def top_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    # The place is a total order, so that the first five rows are the same everywhere.
    place = -F.round(F.col("p_retailprice") * 100).cast("bigint") * 1000000 - F.col("p_partkey")
    overall = part.select(place.alias("Rank"), "p_partkey")
    paths = write_top_by_year(overall, part, work_folder(spark, "years"), 5, "STU_2018", ["p_partkey"], ["p_size"])
    year = F.col("year").cast("string").alias("year")
    top = spark.read.parquet(paths["top"]).select(
        F.lit("top").alias("part"), year, "p_partkey", F.col("Rank").alias("place"), F.lit(None).cast("int").alias("p_size"))
    ids = spark.read.parquet(paths["ids"]).select(
        F.lit("ids").alias("part"), year, "p_partkey", F.lit(None).cast("bigint").alias("place"), "p_size")
    return top.unionByName(ids)


@query("clean_table", f"""
SELECT doc_id, lang, CASE WHEN n_chars > 9990 THEN NULL ELSE n_chars END AS "Size s", CAST(quality AS BIGINT) AS quality,
       CASE WHEN source = 'src1' THEN NULL ELSE source END AS source,
       trim(translate(text, chr(39) || chr(10) || chr(13) || chr(9) || ',"' || chr(92), '    '),
            ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31)) AS text
FROM {JOINED_DOCS}
""")
def clean_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cleaning steps: the doubled size, the uniform flag, the constant and the sparse column go."""
    docs = labelled_documents(spark, sf_dir).select(
        "doc_id", "lang", "text", (F.col("n_chars") * 2).alias("twice"), F.col("n_chars").alias("Size's"),
        "quality", F.col("toxic").cast("string").alias("toxic"),
        F.when(F.col("source") == "src1", "Missing").otherwise(F.col("source")).alias("source"),
        F.lit("x").alias("constant"), F.when(F.col("n_chars") < 100, 1).alias("rare"),
        F.when(F.col("doc_id") < 0, "never").alias("empty"),
    )
    docs = docs.withColumn("twice", F.when(F.col("twice") <= 9990, F.col("twice")))
    return clean(docs, protected=["doc_id"], missing_threshold=0.7, uniform_threshold=0.86, correlation_threshold=0.98).table


@query("clean_long_ids", """
SELECT o_orderkey + 9007199254740992 AS "Student", round(o_totalprice) AS "As number", round(o_totalprice) AS "As text", c_mktsegment
FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 9990 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders)
LEFT JOIN customer ON o_custkey = c_custkey
""")
def clean_long_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids beyond 2 ** 53 keep their digits through cleaning and a join; error codes go from numbers and from text."""
    far = F.lit(9007199254740992)
    orders = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + far).cast("string").alias("Student"), (F.col("o_custkey") + far).alias("School"),
        F.when(F.col("o_totalprice") <= 9990, F.round("o_totalprice")).otherwise(9997.0).alias("As number"),
        F.when(F.col("o_totalprice") <= 9990, F.round("o_totalprice").cast("string")).otherwise("9997").alias("As text"),
    )
    schools = table(spark, sf_dir, "customer").select((F.col("c_custkey") + far).cast("string").alias("School"), "c_mktsegment")
    # Two equal columns would be redundant, so nothing is dropped here.
    ids = ["Student", "School"]
    students, schools = clean(orders, ids).table, clean(schools, ids).table
    return left_join(students, schools, "School").select("Student", F.col("As number"), F.col("As text").cast("double"), "c_mktsegment")


@query("prepare_same_names", """
SELECT '2018/stu' AS tab, p_partkey AS id, p_name FROM part UNION ALL SELECT '2022/stu', p_partkey + 1000000, p_name FROM part
""")
def prepare_same_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one name in two folders stay two tables."""
    root = work_folder(spark, "same-names")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    for year, add in (("2018", 0), ("2022", 1_000_000)):
        write_csv(part.withColumn("id", F.col("id") + add).repartition(3), f"{root}/raw{year}")
        named_files(spark, f"{root}/raw{year}", f"{root}/in/{year}", lambda _, k: f"stu_{k}.csv")
    found = label_folder(spark, f"{root}/in").tables
    tables = [df.withColumn("tab", F.regexp_replace(F.lit(name), r"_\d+", "")) for name, df in found.items()]
    return reduce(DataFrame.unionByName, tables)


@query("transform_tables", f"""
SELECT o_custkey AS "{SCHOOL}", o_orderkey AS "{STUDENT}", o_orderstatus AS "Student ID kind", c_mktsegment AS "School type", c_acctbal AS "School size",
       round(o_totalprice / 50000) AS "Plausible Value 2 in Mathematics", o_totalprice / 500 AS "{SCORE}", {level_sql('o_totalprice / 500')} AS "{SCORE}_level"
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def transform_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    students = _students(spark, sf_dir).withColumn("Final weight", F.lit(1.0)).withColumn("Plausible Value 1 in Reading", F.lit(2.0))
    done = transform({"students": students, "schools": _schools(spark, sf_dir)}, SCORE, [STUDENT, SCHOOL])
    return done["full_merged"]


@query("transform_split", f"""
SELECT o_orderkey AS "{STUDENT}", o_custkey AS "{SCHOOL}", o_orderpriority AS priority, o_orderstatus AS status,
       o_totalprice / 500 AS "{SCORE}", {level_sql('o_totalprice / 500')} AS "{SCORE}_level"
FROM orders
""")
def transform_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table split into two column sets that are joined again on the student."""
    students = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias(STUDENT), F.col("o_custkey").alias(SCHOOL), F.col("o_orderpriority").alias("priority"),
        (F.col("o_totalprice") / 500).alias(SCORE), F.col("o_orderstatus").alias("status"),
    )
    return transform({"students": students}, SCORE, [STUDENT], split_ranges=[(1, 4)])["full_merged"]


def _survey_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as survey lines: country 1-3, school 4-15, student 16-27, status 28, weight 29-32, score 33-52."""
    orders = table(spark, sf_dir, "orders")
    country = F.when(F.col("o_orderpriority") == "1-URGENT", "USA").otherwise("MEX")
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, " ")
    status = F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "2").otherwise("9")
    score = F.lpad(F.col("o_totalprice").cast("decimal(14,2)").cast("string"), 20, " ")
    return orders.select(F.concat(country, pad("o_custkey", 12), pad("o_orderkey", 12), status, F.lit(" 1.0"), score).alias("line"))


def _survey_codebook(spark: SparkSession) -> tuple[Codebook, Layout]:
    names = ["CNT", "SCHOOLID", "STUDENTID", "ST01", "W_FSTUWT", "PV1MATH"]
    labels = ["Country", SCHOOL, STUDENT, "Status", "Final student weight", SCORE]
    starts, ends = [1, 4, 16, 28, 29, 33], [3, 15, 27, 28, 32, 52]
    rows = [("s", k, n, s, e, "(A)", l) for k, (n, s, e, l) in enumerate(zip(names, starts, ends, labels))]
    variables = spark.createDataFrame(rows, "file string, ordinal int, name string, start int, end int, fmt string, label string")
    values = spark.createDataFrame([("s", "ST01", "1", "Finished"), ("s", "ST01", "2", "Open")], "file string, name string, code string, label string")
    missing = spark.createDataFrame([("s", "ST01", "9")], "file string, name string, code string")
    data = spark.createDataFrame([("s", "lines.txt")], "file string, data_file string")
    return Codebook(data, variables, values, missing), Layout(names, starts, ends, labels)


PREPARED = """
FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority <> '1-URGENT'
"""


@query("load_fixed_width", f"""
SELECT 'MEX' AS "Country", CAST(o_custkey AS VARCHAR) AS "{SCHOOL}", CAST(o_orderkey AS VARCHAR) AS "{STUDENT}",
       CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE 'Missing' END AS "Status",
       '1.0' AS "Final student weight", CAST(CAST(o_totalprice AS DECIMAL(14, 2)) AS VARCHAR) AS "{SCORE}"
FROM orders WHERE o_orderpriority <> '1-URGENT'
""")
def load_fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    codebook, layout = _survey_codebook(spark)
    raw = cut_lines(_survey_lines(spark, sf_dir), layout, "MEX")
    return label_table(raw, codebook, "s")


@query("prepare_survey", f"""
SELECT o_custkey AS "{SCHOOL}", o_orderkey AS "{STUDENT}",
       CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' END AS "Status",
       c_mktsegment AS "School type", CASE WHEN c_acctbal > 9990 THEN NULL ELSE c_acctbal END AS "School size",
       CASE WHEN o_totalprice > 9990 THEN NULL ELSE o_totalprice END AS "{SCORE}",
       {level_sql('CASE WHEN o_totalprice > 9990 THEN NULL ELSE o_totalprice END', LARGE_CUTS)} AS "{SCORE}_level"
{PREPARED}
""")
def prepare_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, clean, transform with every stage written and read back; the constant country and weight go."""
    codebook, layout = _survey_codebook(spark)
    students = label_table(cut_lines(_survey_lines(spark, sf_dir), layout, "MEX"), codebook, "s")
    root = work_folder(spark, "stages")
    labeled = {"students": students, "schools": _schools(spark, sf_dir)}
    prepare(spark, root, labeled, Thresholds(uniform=1.0), Roles(school=SCHOOL, student=STUDENT), cuts=LARGE_CUTS)
    return read_stage(spark, root, "leveled", "full_merged")
