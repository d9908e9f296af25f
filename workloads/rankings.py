"""Queries on ranker and selector output derived from the part and lineitem tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import ranking
from panelwright.operators.matching import match_names
from panelwright.plans.results import merge_results, save_top_selection, score_attributes
from panelwright.session import work_folder
from panelwright.sources.model_output import (
    contexts_of,
    normalise_scores,
    parse_ranking_lines,
    parse_selection_texts,
    ranking_method,
    selection_indexes,
)
from workloads.registry import query, spread, table, union_sql

METHODS = ("CORR", "GAIN", "RELIEFF")
FILTERS = ("subset", "wrapper")


def _cents_text(cents):
    """Whole cents as decimal text, so that both engines print the same digits."""
    whole, rest = F.floor(cents / 100).cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    return F.concat(whole, F.lit("."), rest)


def _ranking_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ranker files per brand; each part is one attribute with one line per file."""
    part = spread(table(spark, sf_dir, "part"))
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    size = F.col("p_size").cast("long")
    # The third ranker gives negative scores to the small sizes.
    scores = {
        "CORR": _cents_text(cents), "GAIN": _cents_text(size * 7),
        "RELIEFF": F.concat(F.when(size < 10, "-").otherwise(""), _cents_text(size * 3 + 1)),
    }
    lines = F.array(*[
        F.struct(
            F.concat("p_brand", F.lit(f"_{method}.txt")).alias("file"),
            F.concat(F.lit(" "), text, F.lit("    "), F.col("p_partkey").cast("string"), F.lit(" attr "), F.col("p_partkey").cast("string")).alias("line"),
        )
        for method, text in scores.items()
    ])
    noise = F.array(F.struct(F.concat("p_brand", F.lit("_CORR.txt")).alias("file"), F.lit("Ranked attributes:").alias("line")))
    return part.select("p_partkey", F.inline(F.concat(lines, noise)))


def _rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _ranking_lines(spark, sf_dir)
    named = lines.select(
        F.regexp_extract("file", "^(.*)_", 1).alias("result_name"), "file", ranking_method(F.col("file"), METHODS).alias("method"),
        F.col("p_partkey").alias("line_no"), "line",
    )
    return parse_ranking_lines(named)


RANKINGS_SQL = """
r0 AS (
SELECT p_brand AS result_name, p_brand||'_CORR.txt' AS file, 'CORR' AS method, 'attr '||p_partkey AS attribute, p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part
UNION ALL SELECT p_brand, p_brand||'_GAIN.txt', 'GAIN', 'attr '||p_partkey, p_partkey, p_size * 7 FROM part
UNION ALL SELECT p_brand, p_brand||'_RELIEFF.txt', 'RELIEFF', 'attr '||p_partkey, p_partkey, CASE WHEN p_size < 10 THEN -(p_size * 3 + 1) ELSE p_size * 3 + 1 END FROM part),
rankings AS (SELECT *, CAST(cents AS DOUBLE) / 100 AS score, (CAST(cents AS DOUBLE) / 100) / max(CAST(cents AS DOUBLE) / 100) OVER (PARTITION BY file) AS norm_score FROM r0)
"""


@query("parse_rankings", f"""
WITH {RANKINGS_SQL}
SELECT result_name, file, method, score, p_partkey AS number, attribute, round(norm_score, 8) AS norm_score FROM rankings
""")
def parse_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_scores(_rankings(spark, sf_dir)).drop("line_no").withColumn("norm_score", F.round("norm_score", 8))


def _selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a selector output: its block lists the part and a neighbour without an id."""
    part = spread(table(spark, sf_dir, "part"))
    key = F.col("p_partkey").cast("string")
    kind = F.when(F.col("p_size") > 25, "Wrapper").otherwise("subset")
    text = F.concat(
        F.lit("=== Run ===\n\nSelected attributes: "), key, F.lit("\n      attr "), key,
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("\r\n   attr "), (F.col("p_partkey") + 1).cast("string"))).otherwise(""),
        F.lit("\n\n 0.5 7 not a name\n"),
    )
    texts = part.select(F.concat("p_brand", F.lit("_"), kind, F.lit(".txt")).alias("file"), text.alias("text"))
    parsed = parse_selection_texts(texts)
    indexed = parsed.withColumn("filter_idx", F.explode(selection_indexes(F.col("file"), FILTERS)))
    return indexed.withColumn("result_name", F.regexp_extract("file", "^(.*)_", 1))


SELECTIONS_SQL = """
selections AS (
SELECT p_brand AS result_name, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS filter_idx, 'attr '||p_partkey AS attribute, p_partkey AS attribute_id FROM part
UNION ALL
SELECT p_brand, CASE WHEN p_size > 25 THEN 1 ELSE 0 END, 'attr '||(p_partkey + 1), 0 FROM part WHERE p_type = 'ECONOMY')
"""


@query("parse_selections", f"WITH {SELECTIONS_SQL} SELECT * FROM selections")
def parse_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selections(spark, sf_dir).select("result_name", "filter_idx", "attribute", "attribute_id")


@query("mean_ranking", f"""
WITH {RANKINGS_SQL}
SELECT result_name, attribute, round(avg(norm_score), 8) AS mean_score, count(*) AS files FROM rankings GROUP BY result_name, attribute
""")
def mean_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = ranking.mean_rankings(_rankings(spark, sf_dir))
    return means.select("result_name", "attribute", F.round("mean_score", 8).alias("mean_score"), "files")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_attributes(_rankings(spark, sf_dir), _selections(spark, sf_dir), len(FILTERS))


SCORES_SQL = f"""
{RANKINGS_SQL}, {SELECTIONS_SQL},
means AS (SELECT result_name, attribute, avg(norm_score) AS mean_score, min(p_partkey) AS attribute_id FROM rankings GROUP BY result_name, attribute),
scores AS (SELECT m.result_name, m.attribute, CAST(m.attribute_id AS INTEGER) AS attribute_id,
  m.mean_score * 0.25::DOUBLE + CASE WHEN s0.attribute IS NOT NULL THEN 0.30::DOUBLE ELSE 0.0::DOUBLE END
                      + CASE WHEN s1.attribute IS NOT NULL THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END AS score
  FROM means m
  LEFT JOIN (SELECT DISTINCT result_name, attribute FROM selections WHERE filter_idx = 0) s0 ON s0.result_name = m.result_name AND s0.attribute = m.attribute
  LEFT JOIN (SELECT DISTINCT result_name, attribute FROM selections WHERE filter_idx = 1) s1 ON s1.result_name = m.result_name AND s1.attribute = m.attribute),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY result_name ORDER BY round(score, 10) DESC, attribute) AS INTEGER) AS rank FROM scores)
"""


@query("ensemble_rank", f"""
WITH {SCORES_SQL}
SELECT result_name, rank, attribute_id, attribute, round(score, 8) AS score FROM ranked
""")
def ensemble_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.full_ranking(_scores(spark, sf_dir))
    return ranked.select("result_name", "rank", "attribute_id", "attribute", F.round("score", 8).alias("score"))


@query("top_n_summary", f"""
WITH {SCORES_SQL}
SELECT result_name, rank AS "Rank", round(score, 4) AS "Score", attribute_id AS "Attribute_ID", attribute AS "Attribute_Name" FROM ranked WHERE rank <= 20
""")
def top_n_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.summary_table(ranking.top_ranking(_scores(spark, sf_dir)))


@query("top_attribute", f"""
WITH {SCORES_SQL}
SELECT result_name AS "Dataset", attribute AS "Top Attribute" FROM ranked WHERE rank = 1
""")
def top_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_attributes(ranking.summary_table(ranking.top_ranking(_scores(spark, sf_dir), 1)))


@query("attribute_ids", f"""
WITH {RANKINGS_SQL}
SELECT result_name, attribute, CAST(row_number() OVER (PARTITION BY result_name ORDER BY attribute) AS INTEGER) AS attribute_id
FROM (SELECT DISTINCT result_name, attribute FROM rankings)
""")
def attribute_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankers that number the attributes differently: ids are places in name order."""
    differing = _rankings(spark, sf_dir).withColumn("number", F.col("number") + F.length("method"))
    means = ranking.with_attribute_ids(ranking.mean_rankings(differing))
    return means.select("result_name", "attribute", "attribute_id")


@query("contexts_of_files", union_sql([
    "SELECT doc_id, 'src1' AS result_name FROM documents WHERE contains(lower(source), 'src1')",
    "SELECT doc_id, 'EN' FROM documents WHERE contains(lower('x_'||lang||source), 'en')",
]))
def contexts_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("x_"), "lang", "source")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(contexts_of(name, ["src1", "EN"])).alias("result_name"))


ITEM_COLUMNS = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]


def _column_results(spark: SparkSession, sf_dir: str):
    """Rankings of the lineitem columns by mean and by maximum; one selection."""
    items = table(spark, sf_dir, "lineitem")
    stats = items.select(*[F.col(c).cast("double").alias(c) for c in ITEM_COLUMNS]).unpivot([], ITEM_COLUMNS, "col", "value")
    sums = stats.groupBy("col").agg(F.avg("value").alias("CORR"), F.max("value").alias("GAIN"))
    long = sums.unpivot(["col"], ["CORR", "GAIN"], "method", "score")
    number = F.array_position(F.array(*[F.lit(c) for c in ITEM_COLUMNS]), F.col("col"))
    text = F.concat(F.format_string("%.6f", "score"), F.lit(" "), number.cast("string"), F.lit(" "), "col")
    lines = long.select(
        F.lit("items").alias("result_name"), F.concat(F.lit("items_"), "method").alias("file"), F.lit(1).alias("line_no"), text.alias("line")
    )
    rankings = parse_ranking_lines(lines)
    texts = sums.filter(F.col("GAIN") < 1).select(F.concat(F.lit("Selected attributes: 1\n"), "col").alias("text"))
    selections = parse_selection_texts(texts).withColumn("result_name", F.lit("items")).withColumn("filter_idx", F.lit(0))
    return rankings, selections, items


@query("project_top_n", """
SELECT l_quantity, l_discount, l_tax, l_orderkey, l_shipdate FROM lineitem
""")
def project_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rankings, selections, items = _column_results(spark, sf_dir)
    essentials = {"items": ["l_orderkey", "l_shipdate", "l_tax", "absent"]}
    return merge_results(rankings, selections, items, 1, essentials, top=3).subsets["items"]


@query("rank_and_select", """
WITH s AS (SELECT 'l_quantity' AS c, 2 AS id, avg(l_quantity) AS a, max(l_quantity) AS b, 0.0 AS w FROM lineitem
  UNION ALL SELECT 'l_linenumber', 1, avg(l_linenumber), max(l_linenumber), 0.0 FROM lineitem
  UNION ALL SELECT 'l_discount', 3, avg(l_discount), max(l_discount), 0.30 FROM lineitem
  UNION ALL SELECT 'l_tax', 4, avg(l_tax), max(l_tax), 0.30 FROM lineitem),
t AS (SELECT c, id, (round(a, 6) / max(round(a, 6)) OVER () + b / max(b) OVER ()) / 2 * 0.25::DOUBLE + w AS score FROM s)
SELECT CAST(row_number() OVER (ORDER BY score DESC) AS INTEGER) AS "Rank", round(score, 4) AS "Score", id AS "Attribute_ID",
       c AS "Attribute_Name", c AS mapped_dataset_column, 'exact' AS match_type FROM t QUALIFY row_number() OVER (ORDER BY score DESC) <= 3
""")
def rank_and_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking, mapping to the data set and both result tables written; the rank table is read back."""
    rankings, selections, items = _column_results(spark, sf_dir)
    results = merge_results(rankings, selections, items, 1)
    written = save_top_selection(results.summary, items, work_folder(spark, "results"), 3, ["l_orderkey"])
    return spark.read.parquet(written["Rank_items"])


@query("selected_data", "SELECT l_quantity, l_discount, l_tax, l_orderkey FROM lineitem")
def selected_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rankings, selections, items = _column_results(spark, sf_dir)
    results = merge_results(rankings, selections, items, 1)
    written = save_top_selection(results.summary, items, work_folder(spark, "results"), 3, ["l_orderkey"])
    return spark.read.parquet(written["Data_items"])


LONG_NAMES = [f"Respondent country of birth, category {n}" for n in ("ALPHA", "BRAVO", "CHARLIE")]
SHORT_NAMES = ["Books at home", "School size"]


@query("match_names", """
WITH n AS (SELECT event_id, event_type, CASE user_id % 3 WHEN 0 THEN 'ALPHA' WHEN 1 THEN 'BRAVO' ELSE 'CHARLIE' END AS k FROM events),
a AS (SELECT event_id, event_type, k, CASE event_type
    WHEN 'click' THEN 'Respondent country of birth, category '||k
    WHEN 'error' THEN 'Respondent country of hirth, category '||k
    WHEN 'signup' THEN 'Books at hime' WHEN 'purchase' THEN chr(92)||'School size ' ELSE 'Unrelated '||event_id END AS name FROM n)
SELECT event_id, name,
  CASE event_type WHEN 'click' THEN name WHEN 'error' THEN 'Respondent country of birth, category '||k WHEN 'purchase' THEN 'School size' END AS mapped_dataset_column,
  CASE event_type WHEN 'click' THEN 'exact' WHEN 'error' THEN 'fuzzy' WHEN 'purchase' THEN 'exact' ELSE 'none' END AS match_type
FROM a
""")
def match_names_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with one wrong letter: long ones stay above the similarity cutoff, short ones do not."""
    kind = F.when(F.col("user_id") % 3 == 0, "ALPHA").when(F.col("user_id") % 3 == 1, "BRAVO").otherwise("CHARLIE")
    event = F.col("event_type")
    name = (
        F.when(event == "click", F.concat(F.lit("Respondent country of birth, category "), kind))
        .when(event == "error", F.concat(F.lit("Respondent country of hirth, category "), kind))
        .when(event == "signup", "Books at hime").when(event == "purchase", "\\School size ")
        .otherwise(F.concat(F.lit("Unrelated "), F.col("event_id").cast("string")))
    )
    names = table(spark, sf_dir, "events").select("event_id", name.alias("name"))
    return match_names(names, "name", LONG_NAMES + SHORT_NAMES)
