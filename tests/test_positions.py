import random

import pytest
from pyspark.sql import functions as F

from panelwright.operators.positions import range_totals, rows_at_places, sorted_table, top_per_group, with_row_number


def sample(spark, partitions):
    """One group holds most rows; a NULL group, ties and a single-row group are there too."""
    rng = random.Random(5)
    data = [("hot", rng.randint(0, 50), k) for k in range(4000)] + [("cold", rng.randint(0, 5), 5000 + k) for k in range(30)]
    data += [(None, k % 3, 6000 + k) for k in range(20)] + [("one", 1, 7000)]
    return data, spark.createDataFrame(data, "g string, v int, id int").repartition(partitions)


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_row_number_matches_sorting(spark, partitions):
    data, df = sample(spark, partitions)
    got = {(r["g"], r["id"]): r["rn"] for r in with_row_number(df, ["g"], [F.desc("v"), F.col("id")], "rn").collect()}
    expected = {}
    for group in {g for g, _, _ in data}:
        members = sorted((row for row in data if row[0] == group), key=lambda r: (-r[1], r[2]))
        expected.update({(group, row[2]): k for k, row in enumerate(members, 1)})
    assert got == expected


def test_hot_group_spreads_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, df = sample(spark, 3)
        ranges = sorted_table(df, ["g"], [F.col("v"), F.col("id")])
        sizes = ranges.filter("g = 'hot'").groupBy("__range").count().collect()
        assert len(sizes) > 1
        got = {r["id"]: r["rn"] for r in with_row_number(df, ["g"], [F.col("v"), F.col("id")], "rn").filter("g = 'hot'").collect()}
        assert sorted(got.values()) == list(range(1, 4001))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_rows_at_places_use_weights(spark):
    data = [("a", float(v), 1 + v % 4) for v in range(200)] + [("b", 1.0, 3)]
    df = spark.createDataFrame(data, "col string, value double, n long")
    ranges = sorted_table(df, ["col"], [F.col("value")])
    places = F.array(F.lit(0), F.lit(1), (F.col("total") - 1).cast("int"))
    hits = rows_at_places(ranges, range_totals(ranges, ["col"], F.col("n")), "col", "n", places)
    found = {(r["col"], r["place"]): r["value"] for r in hits.collect()}
    expanded = {g: [v for c, v, n in sorted(data) if c == g for _ in range(n)] for g in "ab"}
    assert found == {(g, p): expanded[g][p] for g in "ab" for p in (0, 1, len(expanded[g]) - 1)}


def test_top_per_group_limits_before_the_shuffle(spark):
    _, df = sample(spark, 3)
    top = top_per_group(df, ["g"], [F.col("v"), F.col("id")], 2, "k")
    assert top.groupBy("g").count().filter("count > 2").count() == 0
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
