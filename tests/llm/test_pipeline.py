"""Queries with reference SQL, and the pipeline's stages, each judged on its own input."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelwright.llm import queries
from tools.compare import duck, rows_by_name

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    df = queries.QUERIES[name](spark, SF_DIR)
    cursor = duck(SF_DIR).execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_by_name(df.columns, df.collect()) == rows_by_name(names, cursor.fetchall())


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in queries.QUERIES if name.startswith("op")} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in queries.QUERIES


def test_stages(spark, tmp_path):
    deal = [" ".join(f"word{(7 * k + j * j) % 997}" for j in range(120)) + " the and of" * 4 for k in range(6)]
    passage = " ".join(f"exam{j}" for j in range(12))
    rows = [
        (1, deal[0]), (2, deal[0]), (3, deal[0].replace("word0 ", "other ")), (4, deal[1] + " " + passage), (5, deal[2] + "\npassword = hunter2hunter2 end"),
        (6, "### $$$ %%% " * 40), (7, None), (8, "too short"), (9, deal[3]), (None, deal[4]),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], str(tmp_path)))
        assert kept[-1].columns == docs.columns
    ids = [sorted(r["doc_id"] or 0 for r in df.select("doc_id").collect()) for df in kept]
    assert ids[1] == [0, 1, 2, 3, 4, 5, 9] and ids[2] == ids[3] == ids[4] == [0, 1, 4, 5, 9]
    texts = {r["doc_id"]: r["text"] for r in kept[-1].collect()}
    assert "exam" not in texts[4] and texts[5].endswith("[SECRET] end") and texts[9] == deal[3]
    assert kept[-1].filter(F.col("n_chars") != F.char_length("text")).count() == 0
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] or 0 for r in last.collect()) == ids[4]
    assert last.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def written(spark, root, rows, items):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(root / "benchmark.parquet"))
    return corpus_pipeline.run(spark, str(root)).collect()


def test_empty_tables(spark, tmp_path):
    assert written(spark, tmp_path, [], []) == []


def test_very_long_texts_and_missing_columns(spark, tmp_path):
    """Megabytes of text, a copy of it with one word changed, and rows without any value."""
    deal = random.Random(8)
    words = ["the" if deal.random() < 0.1 else f"word{deal.randrange(90_000)}" for _ in range(250_000)]
    long = " ".join(words)
    passage = " ".join(words[1000:1012])
    near = long.replace(words[70_001], "changed", 1)
    rows = [(1, long, None, None, None), (2, near, "en", "s", 1), (None, None, None, None, None), (3, " ".join(words[5:400]), None, "s", 0)]
    found = written(spark, tmp_path, rows, [(1, passage), (2, None), (3, "")])
    assert sorted(r["doc_id"] for r in found) == [1, 3]
    first = next(r for r in found if r["doc_id"] == 1)
    assert len(first["decoded"]) > 1_500_000 and passage not in first["decoded"] and len(first["ids"]) == 4 * first["n_tokens"]
