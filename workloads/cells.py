"""Queries on single cells: filters, cuts, labels, value cleaning, types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions import text
from panelwright.functions.names import clean_attribute_headers, clean_headers
from panelwright.operators.columns import (
    clean_values,
    missing_labels_as_null,
    na_tokens_as_null,
    newlines_escaped,
    not_numeric,
    numbers_or_categories,
    sentinels_as_null,
)
from panelwright.operators.labels import decode_labels, label_headers
from panelwright.session import work_folder
from panelwright.sinks.layout import scan_country, write_by_country
from panelwright.sinks.writers import nan_marked
from panelwright.sources.codebook import Layout, decode_table, parse_codebook
from panelwright.sources.fixed_width import cut_lines
from panelwright.sources.tables import preview, rows_of_country
from workloads.registry import query, spread, table, union_sql

NUMBER_SQL = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


@query("country_filter", "SELECT * FROM customer WHERE upper(c_mktsegment) = 'FURNITURE'")
def country_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of_country(table(spark, sf_dir, "customer"), "furniture", "c_mktsegment")


@query("country_scan", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE upper(o_orderstatus) = 'F'")
def country_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short code in any letter case, tested by the Parquet reader."""
    return rows_of_country(table(spark, sf_dir, "orders"), "f", "o_orderstatus").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("country_layout", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE upper(o_orderstatus) = 'F'
UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE upper(o_orderstatus) = 'P'
""")
def country_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labeled rows laid out by country, and two countries read back from their own files."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = write_by_country(orders, work_folder(spark, "by-country"), "o_orderstatus", ["o_orderkey"])
    return scan_country(spark, path, "f", "o_orderstatus").unionByName(scan_country(spark, path, "P", "o_orderstatus"))


@query("line_prefix_filter", "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'ECO')")
def line_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return part.filter(text.starts_with_code(F.col("p_type"), "ECO"))


def _customer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as fixed-width lines: key 1-12, segment 13-24 (blank for one segment), name 25-48."""
    segment = F.when(F.col("c_mktsegment") == "FURNITURE", "").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lpad(F.col("c_custkey").cast("string"), 12, " "), F.rpad(segment, 12, " "), F.rpad("c_name", 24, " ")).alias("line")
    )


@query("fixed_width_cut", """
SELECT CAST(c_custkey AS VARCHAR) AS "KEY", nullif(c_mktsegment, 'FURNITURE') AS "SEGMENT",
       c_name AS "NAME"
FROM customer
""")
def fixed_width_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = Layout(["KEY", "SEGMENT", "NAME"], [1, 13, 25], [12, 24, 48], [None, None, None])
    return cut_lines(_customer_lines(spark, sf_dir), layout)


@query("label_decode", """
SELECT o_orderkey AS "Order", CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open'
       ELSE o_orderstatus END AS "State", o_orderpriority
FROM orders
""")
def label_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    labels = spark.createDataFrame(
        [("o_orderstatus", "F", "Finished"), ("o_orderstatus", ' "O" ', "Open")], "name string, code string, label string"
    )
    decoded = decode_labels(orders, labels)
    return label_headers(decoded, [("o_orderkey", "Order"), ("o_orderstatus", "State"), ("o_orderpriority", None)])


@query("label_decode_joined", """
SELECT l.l_orderkey, l.l_linenumber, p.p_name AS l_partkey
FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
""")
def label_decode_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variable with many codes: its code list is joined instead of written into the plan."""
    labels = table(spark, sf_dir, "part").select(
        F.lit("l_partkey").alias("name"), F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("label")
    )
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return decode_labels(items, labels, inline_limit=0)


@query("label_decode_duplicates", """
SELECT 'listed' AS way, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open still' ELSE o_orderstatus END AS o_orderstatus
FROM orders UNION ALL
SELECT 'joined', o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open still' ELSE o_orderstatus END FROM orders
""")
def label_decode_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that are equal as text, and missing codes, give one row and the same label on both paths."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    labels = spark.createDataFrame([
        ("o_orderstatus", "O", "Open", 1), ("o_orderstatus", ' "O" ', "Open still", 2), ("o_orderstatus", "F", "Finished", 3),
        ("o_orderstatus", None, "Nothing", 4), (None, "P", "Nobody", 5), ("o_orderstatus", "P", None, 6),
    ], "name string, code string, label string, ordinal int")
    listed, joined = decode_labels(orders, labels), decode_labels(orders, labels, inline_limit=0)
    return listed.withColumn("way", F.lit("listed")).unionByName(joined.withColumn("way", F.lit("joined")))


@query("value_clean", r"""
SELECT doc_id, trim(translate(translate(text, chr(39)||chr(10)||chr(13)||chr(9), '    '), ',"\', ''),
                    ' '||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)||chr(160)||chr(8195)||chr(8201)||chr(12288)) AS text
FROM documents
""")
def value_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_values(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("header_clean", """
SELECT c_custkey AS "key  no.", c_name AS "Customer s name", c_nationkey AS "Nation code",
       c_acctbal AS "Nation code_2", c_mktsegment AS "NATION CODE_3"
FROM customer
""")
def header_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = [" key\t\nno.", "Customer's, \"name\"", "Nation\\ code", "Nation code", "NATION CODE"]
    return clean_headers(table(spark, sf_dir, "customer").toDF(*headers))


@query("attribute_header_clean", """
SELECT s_suppkey AS "Supplier key", s_name AS "vName", s_acctbal AS "Balance" FROM supplier
""")
def attribute_header_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("Supplier\v key\x01"), F.col("s_name").alias("\\vvName"), F.col("s_acctbal").alias(" \\Balance\\v")
    )
    return clean_attribute_headers(named)


@query("attribute_clean", r"""
SELECT conv_id, turn, trim(regexp_replace(text, '(\\v|[\x00-\x1F]|\\)+', '', 'g')) AS text FROM conversations
""")
def attribute_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    return talks.select("conv_id", "turn", text.clean_attribute(F.col("text")).alias("text"))


@query("missing_tokens", """
SELECT event_id, CASE WHEN event_type IN ('error', 'Invalid') THEN NULL ELSE event_type END AS event_type,
       CASE WHEN value < 50 THEN NULL ELSE 'ok' END AS mark
FROM events
""")
def missing_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("value") < 50, "#N/A").otherwise("ok").alias("mark")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", mark)
    return na_tokens_as_null(missing_labels_as_null(events, ["event_type"], ("error", "Invalid")))


@query("sentinel_null", """
SELECT c_custkey, CASE WHEN c_acctbal > 9990 THEN NULL ELSE c_acctbal END AS c_acctbal,
       CASE WHEN c_custkey * 100 > 9990 THEN NULL ELSE c_custkey * 100 END AS scaled
FROM customer
""")
def sentinel_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    chosen = customer.select("c_custkey", "c_acctbal", (F.col("c_custkey") * 100).alias("scaled"))
    return sentinels_as_null(chosen, protected=["c_custkey"])


def _part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as text, with traps: a suffix that is no number, an exponent, an all-missing column."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").cast("string").alias("p_partkey"), "p_name", "p_brand",
        F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")).alias("p_size"),
        F.concat(F.col("p_size").cast("string"), F.lit("d")).alias("p_suffix"),
        F.concat(F.col("p_size").cast("string"), F.lit("e2")).alias("p_power"),
        F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).alias("p_gaps"),
        F.lit(None).cast("string").alias("p_none"),
    )


_PART_TEXTS = {
    "p_partkey": "CAST(p_partkey AS VARCHAR)", "p_name": "p_name", "p_brand": "p_brand",
    "p_size": "' '||p_size||' '", "p_suffix": "p_size||'d'", "p_power": "p_size||'e2'",
    "p_gaps": "CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) END", "p_none": "CAST(NULL AS VARCHAR)",
}


@query("numeric_or_category", union_sql([
    f"SELECT '{n}' AS col, coalesce(bool_or(v IS NOT NULL AND NOT regexp_matches(v, {NUMBER_SQL})), false) AS mixed, "
    f"coalesce(bool_and(regexp_full_match(trim(v), '[+-]?[0-9]{{1,19}}') AND try_cast(trim(v) AS BIGINT) IS NOT NULL) FILTER (WHERE v IS NOT NULL), false) AS whole "
    f"FROM (SELECT {e} AS v FROM part)" for n, e in _PART_TEXTS.items()
]))
def numeric_or_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_numeric(_part_texts(spark, sf_dir))


@query("typed_columns", """
SELECT p_partkey, p_name, p_brand, CAST(p_size AS BIGINT) AS p_size,
       p_size||'d' AS p_suffix, CAST(p_size AS DOUBLE) * 100 AS p_power,
       CASE WHEN p_size > 25 THEN CAST(p_size AS BIGINT) END AS p_gaps, CAST(NULL AS DOUBLE) AS p_none
FROM part
""")
def typed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbers_or_categories(_part_texts(spark, sf_dir))[0]


@query("newline_escape", r"""
SELECT doc_id, trim(regexp_replace(text, '[\n\r]', '\\n', 'g'),
                    ' '||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)||chr(160)||chr(8195)||chr(8201)||chr(12288)) AS text
FROM documents
""")
def newline_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newlines_escaped(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("nan_marked", """
SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, coalesce(CAST(l.quality AS VARCHAR), 'nan') AS quality,
       coalesce(CAST(l.toxic AS VARCHAR), 'nan') AS toxic
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def nan_marked_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return nan_marked(joined)


@query("year_of_name", """
SELECT doc_id, CASE WHEN source = 'src0' THEN 'unknown_year' ELSE 'src'||substr(source, 4) END AS year
FROM documents
""")
def year_of_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("source") != "src0", F.concat(F.lit("STU_"), F.col("lang"), F.lit("_"), F.col("source")))
    return table(spark, sf_dir, "documents").select("doc_id", text.year_of_name(name).alias("year"))


@query("preview_rows", "SELECT count(*) AS rows FROM (SELECT * FROM lineitem LIMIT 100)")
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preview is a 100-row look at a table; which rows it shows is open."""
    return preview(table(spark, sf_dir, "lineitem"), 100).agg(F.count(F.lit(1)).alias("rows"))


def _syntax_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One syntax file per part: three variables, labels, missing codes, value labels."""
    part = spread(table(spark, sf_dir, "part"))
    lines = [
        F.lit("* header line."),
        F.concat(F.lit('DATA LIST FILE "C:\\data\\part'), F.col("p_partkey").cast("string"), F.lit('.txt"')),
        F.concat(F.lit("CNT       1 - "), F.col("p_size").cast("string"), F.lit("   (A)")),
        F.lit("  Brand     60 - 69   (A)"),
        F.lit("Size      70 - 71   (F,0)"),
        F.lit("VARIABLE LABELS"),
        F.lit('cnt "Country code"'),
        F.concat(F.lit('BRAND      "Brand of '), F.col("p_name"), F.lit('"')),
        F.lit('UNKNOWN "not a variable"'),
        F.lit("Missing values SIZE (98,99)."),
        F.lit("value labels"),
        F.lit("/BRAND CNT"),
        F.concat(F.lit("1 '"), F.col("p_brand"), F.lit("'")),
        F.concat(F.lit("2 \""), F.col("p_type"), F.lit("\"")),
        F.lit("/SIZE"),
        F.concat(F.col("p_size").cast("string"), F.lit(' "exactly this"')),
        F.lit('98 "N/A"'),
        F.lit("."),
        F.lit("9 \"outside the section\""),
    ]
    return part.select(F.col("p_partkey").cast("string").alias("file"), F.concat_ws("\r\n", *lines).alias("text"))


@query("codebook_variables", """
SELECT CAST(p_partkey AS VARCHAR) AS file, 'CNT' AS name, 1 AS first, p_size AS last, '(A)' AS fmt, 'Country code' AS label FROM part
UNION ALL
SELECT CAST(p_partkey AS VARCHAR), 'BRAND', 60, 69, '(A)', 'Brand of '||p_name FROM part
UNION ALL
SELECT CAST(p_partkey AS VARCHAR), 'SIZE', 70, 71, '(F,0)', NULL FROM part
""")
def codebook_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    variables = parse_codebook(_syntax_texts(spark, sf_dir)).variables
    return variables.select("file", "name", F.col("start").alias("first"), F.col("end").alias("last"), "fmt", "label")


@query("codebook_labels", """
WITH f AS (SELECT CAST(p_partkey AS VARCHAR) AS file, p_brand, p_type, p_size FROM part)
SELECT file, v.name, '1' AS code, p_brand AS label FROM f, (VALUES ('BRAND'), ('CNT')) v(name)
UNION ALL SELECT file, v.name, '2', p_type FROM f, (VALUES ('BRAND'), ('CNT')) v(name)
UNION ALL SELECT file, 'SIZE', CAST(p_size AS VARCHAR), 'exactly this' FROM f
UNION ALL SELECT file, 'SIZE', '98', 'N/A' FROM f
UNION ALL SELECT file, 'SIZE', '99', 'Missing' FROM f
""")
def codebook_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_table(parse_codebook(_syntax_texts(spark, sf_dir)))


@query("codebook_data_files", """
SELECT CAST(p_partkey AS VARCHAR) AS file, 'part'||p_partkey||'.txt' AS data_file FROM part
""")
def codebook_data_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_codebook(_syntax_texts(spark, sf_dir)).data_files
