"""Queries on column statistics: frequencies, missing and uniform columns, correlation, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import frequencies, moments, profile
from panelwright.operators.positions import with_row_number
from workloads.registry import query, table, union_sql

LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
PART_TEXTS = ["p_name", "p_brand", "p_type"]
ORDER_TEXTS = ["o_orderstatus", "o_orderpriority"]
JOINED_DOCS = "(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
JOINED_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(*JOINED_COLUMNS)


def _frequency_sql(name: str, columns: list[str]) -> str:
    return union_sql([
        f"SELECT '{name}' AS tab, '{c}' AS col, {c} AS value, count(*) AS n FROM {name} GROUP BY {c}" for c in columns
    ])


@query("value_frequency", union_sql([_frequency_sql("part", PART_TEXTS), _frequency_sql("orders", ORDER_TEXTS)]))
def value_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = frequencies.value_frequencies(table(spark, sf_dir, "part"), PART_TEXTS)
    orders = frequencies.value_frequencies(table(spark, sf_dir, "orders"), ORDER_TEXTS)
    return parts.withColumn("tab", F.lit("part")).unionByName(orders.withColumn("tab", F.lit("orders")))


@query("missing_ratio", union_sql([
    f"SELECT '{c}' AS col, count(*) AS total, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, "
    f"round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM {JOINED_DOCS}" for c in JOINED_COLUMNS
]))
def missing_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = frequencies.missing_ratios(labelled_documents(spark, sf_dir))
    return ratios.withColumn("ratio", F.round("ratio", 6))


@query("drop_sparse", f"SELECT doc_id, text, lang, source, n_chars FROM {JOINED_DOCS}")
def drop_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequencies.drop_sparse(labelled_documents(spark, sf_dir), 0.5)[0]


def _uniformity_sql(name: str, columns: list[str]) -> str:
    return union_sql([
        f"SELECT '{c}' AS col, CAST(sum(n) AS BIGINT) AS present, max(n) AS top, round(max(n) / sum(n)::DOUBLE, 6) AS ratio "
        f"FROM (SELECT {c}, count(*) AS n FROM {name} WHERE {c} IS NOT NULL GROUP BY {c})" for c in columns
    ])


@query("uniformity", union_sql([_uniformity_sql("labels", ["quality", "toxic"]), _uniformity_sql("orders", ["o_custkey", *ORDER_TEXTS])]))
def uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = frequencies.uniformity_ratios(table(spark, sf_dir, "labels"), ["quality", "toxic"])
    orders = frequencies.uniformity_ratios(table(spark, sf_dir, "orders"), ["o_custkey", *ORDER_TEXTS])
    return labels.unionByName(orders).withColumn("ratio", F.round("ratio", 6))


@query("drop_uniform", "SELECT doc_id, quality FROM labels")
def drop_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("constant", F.lit("one"))
    return frequencies.drop_uniform(labels, 0.86, protected=["doc_id"])[0]


@query("drop_constant", "SELECT doc_id, quality, toxic FROM labels")
def drop_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("constant", F.lit("one"))
    return frequencies.drop_uniform(labels)[0]


@query("nominal_encode", """
SELECT p_partkey, dense_rank() OVER (ORDER BY coalesce(nullif(p_brand, 'Brand#13'), 'nan')) - 1 AS p_brand,
       dense_rank() OVER (ORDER BY coalesce(p_name, 'nan')) - 1 AS p_name,
       dense_rank() OVER (ORDER BY p_type) - 1 AS p_type
FROM part
""")
def nominal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.nullif("p_brand", F.lit("Brand#13")).alias("p_brand"), "p_name", "p_type"
    )
    return frequencies.encode_nominal(part, ["p_brand", "p_name", "p_type"], inline_limit=10)


@query("nominal_classes", """
SELECT 'o_orderpriority' AS col, o_orderpriority AS value, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code
FROM (SELECT DISTINCT o_orderpriority FROM orders)
UNION ALL
SELECT 'o_custkey', v, row_number() OVER (ORDER BY v) - 1 FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders)
""")
def nominal_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequencies.nominal_codes(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_custkey"])


@query("row_positions", """
SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_returnflag
       ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS place
FROM lineitem
""")
def row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in three large groups, none of them sorted in one task."""
    order = [F.desc("l_extendedprice"), *[F.asc(c) for c in (
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")]]
    placed = with_row_number(table(spark, sf_dir, "lineitem"), ["l_returnflag"], order, "place")
    return placed.select("l_orderkey", "l_linenumber", "l_partkey", "place")


PAIR_COLUMNS = ["l_quantity", "l_discount", "l_tax", "gap"]
PAIR_SOURCE = "(SELECT l_quantity, l_discount, l_tax, CASE WHEN l_returnflag <> 'R' THEN l_linenumber END AS gap FROM lineitem)"


@query("pair_sums", union_sql([
    f"SELECT {i} AS i, {j} AS j, count(*) FILTER (ok) AS n, round(sum(x) FILTER (ok), 6) AS sx, round(sum(y) FILTER (ok), 6) AS sy, "
    f"round(sum(x*x) FILTER (ok), 6) AS sxx, round(sum(y*y) FILTER (ok), 6) AS syy, round(sum(x*y) FILTER (ok), 6) AS sxy "
    f"FROM (SELECT CAST({PAIR_COLUMNS[i]} AS DOUBLE) AS x, CAST({PAIR_COLUMNS[j]} AS DOUBLE) AS y, x IS NOT NULL AND y IS NOT NULL AS ok FROM {PAIR_SOURCE})"
    for i in range(4) for j in range(i + 1)
]))
def pair_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("gap", F.when(F.col("l_returnflag") != "R", F.col("l_linenumber")))
    sums = moments.pair_sums(items, PAIR_COLUMNS)
    rounded = [F.round(s, 6).alias(s) for s in moments.SUMS[1:]]
    return sums.select("i", "j", F.col("n").cast("long").alias("n"), *rounded)


def _corr_sql(columns: list[str], source: str, extra: str = "") -> str:
    return union_sql([
        f"SELECT '{columns[i]}' AS col_i, '{columns[j]}' AS col_j, count(*) FILTER ({columns[i]} IS NOT NULL AND {columns[j]} IS NOT NULL) AS n, "
        f"round(abs(corr({columns[i]}, {columns[j]})), 6) AS r FROM {source}{extra}"
        for i in range(len(columns)) for j in range(i)
    ])


@query("corr_matrix", _corr_sql(LINE_NUMBERS, "lineitem"))
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    corr = moments.absolute_correlations(table(spark, sf_dir, "lineitem"), LINE_NUMBERS)
    return corr.select("col_i", "col_j", "n", F.round("r", 6).alias("r"))


@query("corr_embeddings", """
WITH d AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)
SELECT CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j, count(*) AS n, round(abs(corr(a.x, b.x)), 6) AS r
FROM d a JOIN d b ON a.vec_id = b.vec_id AND a.k > b.k GROUP BY a.k, b.k
""")
def corr_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table: every dimension of the vectors as a column, in column blocks of 40."""
    vectors = table(spark, sf_dir, "embeddings")
    wide = vectors.select(*[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(64)])
    corr = moments.correlations(wide, wide.columns, block=40)
    return corr.select("i", "j", "n", F.round(F.abs("r"), 6).alias("r"))


@query("corr_pairs", """
SELECT 'p_retailprice' AS col_i, 'p_partkey' AS col_j, round(r, 5) AS r
FROM (SELECT abs(corr(p_retailprice, p_partkey)) AS r FROM part) WHERE r > 0.4
UNION ALL
SELECT 'p_size' AS col_i, 'p_partkey' AS col_j, round(r, 5) FROM (SELECT abs(corr(p_size, p_partkey)) AS r FROM part) WHERE r > 0.4
UNION ALL
SELECT 'p_retailprice', 'p_size', round(r, 5) FROM (SELECT abs(corr(p_retailprice, p_size)) AS r FROM part) WHERE r > 0.4
UNION ALL
SELECT 'constant', c, r FROM (SELECT 'p_size' AS c, 0.0 AS r) WHERE false
""")
def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant column has no correlation and never forms a pair."""
    part = table(spark, sf_dir, "part").withColumn("constant", F.lit(7))
    corr = moments.absolute_correlations(part, moments.numeric_columns(part))
    return moments.correlated_pairs(corr, 0.4).select("col_i", "col_j", F.round("r", 5).alias("r"))


@query("drop_correlated", """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag FROM lineitem
""")
def drop_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy carries less of the target than its original (noise from another column), so the copy goes."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 2 + F.col("l_tax") * 40).alias("noisy"),
        "l_quantity", "l_discount", "l_returnflag",
        (F.col("l_quantity") + F.col("l_discount") / 10).alias("target"),
    )
    return moments.drop_correlated(items, 0.9, target="target", protected=["l_orderkey"])[0].drop("target")


@query("drop_correlated_untargeted", """
SELECT l_linenumber, l_quantity * 3 AS tripled, l_returnflag AS flag_copy FROM lineitem
""")
def drop_correlated_untargeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a target the earlier column of a pair goes; text columns take part by their codes."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_linenumber", "l_quantity", (F.col("l_quantity") * 3).alias("tripled"),
        "l_returnflag", F.col("l_returnflag").alias("flag_copy"),
    )
    return moments.drop_correlated(items, 0.99)[0]


@query("profile_common", union_sql([
    f"SELECT '{c}' AS name, '{t}' AS dtype, count(*) AS total_count, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_count, "
    f"round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 6) AS missing_percentage, count({c}) AS non_missing_count FROM {JOINED_DOCS}"
    for c, t in zip(JOINED_COLUMNS, ["bigint", "string", "string", "string", "bigint", "int", "int"])
]))
def profile_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = profile.common_profile(labelled_documents(spark, sf_dir))
    return common.withColumn("missing_percentage", F.round("missing_percentage", 6))


# Digits at which no mean of these columns ends in an exact half.
MEAN_DIGITS = {"l_extendedprice": 3}


def _numeric_sql(columns: dict[str, str], source: str) -> str:
    return union_sql([
        f"SELECT '{name}' AS name, round(avg({e}), {MEAN_DIGITS.get(name, 9)}) AS mean, round(stddev_samp({e}), 5) AS std, round(var_samp({e}), 2) AS variance, "
        f"CAST(min({e}) AS DOUBLE) AS min, CAST(max({e}) AS DOUBLE) AS max, round(quantile_cont({e}, 0.25), 6) AS q25, round(quantile_cont({e}, 0.5), 6) AS median, "
        f"round(quantile_cont({e}, 0.75), 6) AS q75, count(DISTINCT {e}) AS unique_count FROM {source}"
        for name, e in columns.items()
    ])


def _rounded_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    result = profile.numeric_profile(df, columns)
    return result.select(
        "name", F.when(F.col("name").isin(*MEAN_DIGITS), F.round("mean", 3)).otherwise(F.round("mean", 9)).alias("mean"), F.round("std", 5).alias("std"), F.round("variance", 2).alias("variance"),
        "min", "max", *[F.round(c, 6).alias(c) for c in ("q25", "median", "q75")], "unique_count",
    )


@query("profile_numeric", _numeric_sql({c: f"CAST({c} AS DOUBLE)" for c in LINE_NUMBERS}, "lineitem"))
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_profile(table(spark, sf_dir, "lineitem"), LINE_NUMBERS)


@query("profile_numeric_gaps", _numeric_sql(
    {c: f"CAST({c} AS DOUBLE)" for c in ("quality", "toxic", "n_chars")} | {"nothing": "CAST(NULL AS DOUBLE)"}, JOINED_DOCS))
def profile_numeric_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = labelled_documents(spark, sf_dir).withColumn("nothing", F.lit(None).cast("double"))
    return _rounded_profile(docs, ["quality", "toxic", "n_chars", "nothing"])


@query("profile_sketch", """
SELECT c AS name, p AS probability, true AS within FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_orderkey')) a(c), (VALUES (0.25), (0.5), (0.75)) b(p)
""")
def profile_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles from the sketch: the share of rows at or below each lies within a thousandth of its probability, ties aside."""
    names = ["l_quantity", "l_extendedprice", "l_orderkey"]
    items = table(spark, sf_dir, "lineitem")
    found = profile.numeric_profile(items, names, exact=False)
    quartiles = found.select("name", F.inline(F.array(*[
        F.struct(F.lit(p).cast("decimal(3,2)").alias("probability"), F.col(c).alias("quartile")) for p, c in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))])))
    rows = profile.number_frequencies(items, names).withColumnRenamed("col", "name")
    shares = rows.join(F.broadcast(quartiles), "name").groupBy("name", "probability").agg(*[
        (F.sum(F.when(test, F.col("n")).otherwise(0)) / F.sum("n")).alias(c)
        for c, test in (("below", F.col("value") < F.col("quartile")), ("upto", F.col("value") <= F.col("quartile")))])
    near = (F.col("below") <= F.col("probability") + 0.001) & (F.col("upto") >= F.col("probability") - 0.001)
    return shares.select("name", "probability", near.alias("within"))


@query("histogram_30", """
WITH v AS (SELECT 'l_extendedprice' AS col, l_extendedprice AS x FROM lineitem
           UNION ALL SELECT 'l_tax', l_tax FROM lineitem
           UNION ALL SELECT 'constant', 5.0::DOUBLE FROM lineitem),
r AS (SELECT col, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
             CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM v GROUP BY col),
g AS (SELECT v.col, x, lo, hi, least(CAST(floor((x - lo) * (30.0::DOUBLE / (hi - lo))) AS INTEGER), 29) AS b, (hi - lo) / 30 AS step
      FROM v JOIN r ON v.col = r.col),
e AS (SELECT col, CASE WHEN x < b * step + lo THEN b - 1 WHEN x >= (b + 1) * step + lo AND b < 29 THEN b + 1 ELSE b END AS bin FROM g),
c AS (SELECT col, bin, count(*) AS n FROM e GROUP BY col, bin),
k AS (SELECT col, lo, hi, unnest(generate_series(0, 29)) AS bin FROM r)
SELECT k.col, CAST(k.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, round(k.bin * ((hi - lo) / 30) + lo, 6) AS edge
FROM k LEFT JOIN c ON k.col = c.col AND k.bin = c.bin
""")
def histogram_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("constant", F.lit(5.0))
    numbers = profile.number_frequencies(items, ["l_extendedprice", "l_tax", "constant"])
    packed = profile.histograms(numbers, profile.value_limits(numbers)).select("col", F.posexplode("histogram.counts").alias("bin", "n"), "histogram.bin_edges")
    return packed.select("col", "bin", "n", F.round(F.get("bin_edges", F.col("bin")), 6).alias("edge"))


@query("profile_categorical", union_sql([
    f"""SELECT * FROM (
WITH c AS (SELECT {c} AS value, count(*) AS n FROM part GROUP BY {c}),
r AS (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS k, count(*) OVER () AS kinds,
             first_value(value) OVER (ORDER BY n DESC, value) AS best, sum(n) OVER () AS total FROM c)
SELECT '{c}' AS name, kinds AS unique_count, best AS most_common, value, n AS "count" FROM r WHERE k <= 20
UNION ALL
SELECT '{c}', max(kinds), max(best), '__OTHER__', CAST(max(total) - sum(n) AS BIGINT) FROM r WHERE k <= 20 HAVING max(kinds) > 20)"""
    for c in ("p_brand", "p_type", "p_name")
]))
def profile_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiled = frequencies.categorical_profile(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_name"])
    return profiled.select("name", "unique_count", "most_common", F.inline("value_counts"))


@query("profile_table", union_sql([
    f"SELECT '{c}' AS name, '{k}' AS type, count(*) AS total_count, count(DISTINCT {c}) AS unique_count, "
    f"{'round(avg(' + c + '), 6)' if k == 'numeric' else 'CAST(NULL AS DOUBLE)'} AS mean FROM part"
    for c, k in (("p_partkey", "numeric"), ("p_name", "categorical"), ("p_brand", "categorical"), ("p_type", "categorical"),
                 ("p_size", "numeric"), ("p_retailprice", "numeric"))
]))
def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = profile.profile(table(spark, sf_dir, "part"))
    return result.select("name", "type", "total_count", "unique_count", F.round("mean", 6).alias("mean"))


@query("constant_columns", """
SELECT tab, col FROM (VALUES ('items', 'zero'), ('items', 'flag'), ('items', 'far')) AS t(tab, col) CROSS JOIN (SELECT 1 FROM lineitem LIMIT 1)
""")
def constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed zeros are one value, neighbouring long integers are two, in the wide form and in the long one; an
    empty table has no constant column. A column that only one form finds would show as a difference."""
    sign = F.when(F.col("l_linenumber") == 1, 0.0).otherwise(-0.0)
    far = F.lit(9007199254740992)
    items = table(spark, sf_dir, "lineitem").select(
        sign.alias("zero"), F.lit("x").alias("flag"), far.alias("far"), (far + F.col("l_linenumber") % 2).alias("near"), "l_quantity")
    found = []
    for name, df in (("items", items), ("empty", items.filter("1 = 0"))):
        wide, long = (set(frequencies.constant_columns(df, df.columns, limit)) for limit in (60, 0))
        found += [(name, c) for c in sorted(wide & long)] + [(name, f"{c} differs") for c in sorted(wide ^ long)]
    return spark.createDataFrame(found, "tab string, col string")
