"""Driver queries of the training-data operators, with reference SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import (
    bpe, decontamination, filter_audit, licenses, lm_scoring, negatives, pieces, quality, repeats, secrets, sharding, simhash, warc,
)
from panelwright.llm.common import whole_text
from workloads.registry import Query, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


ORACLES["op9_quality_rules"] = rf"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), covered AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words
  FROM windows, range(3) AS r(k) WHERE n > 1 GROUP BY doc_id
), amounts AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN {quality.STOP_WORDS!r})) AS n_stop_words
  FROM words w LEFT JOIN covered c ON c.doc_id = w.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND 1000 * word_chars BETWEEN 2000 * n_words AND 12000 * n_words AND 1000 * n_symbols <= 100 * n_words
         AND 1000 * n_stop_words >= 20 * n_words AND 1000 * n_dup_lines <= 500 * n_lines AS kept
FROM amounts"""


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts, base rule and verdict of the threshold table for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", quality.measured(whole_text()).alias("m"))
    return docs.select(
        "doc_id", *[F.col("m")[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        quality.base_failed(F.col("m")).alias("base_failed"), quality.kept(F.col("m")).alias("kept"),
    )


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    path = word_vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    coded = bpe.round_trip(docs, path)
    return coded.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes."""
    docs = table(spark, sf_dir, "documents")
    return sharding.shards(docs, levels=3).select(
        F.col("row.doc_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, which are read back."""
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, archives.read()).select(*warc.payload_facts())


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and linked spans of every document."""
    found, _ = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_assign", "n_access", "n_hex",
        F.sha2(secrets.spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.spelled(F.col("spans")).alias("spans"),
    )


@query
def op3_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark window."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that remain without repeated strings of 400 bytes, and its words in passages of fifty words
    that another document has."""
    found = repeats.removals(table(spark, sf_dir, "documents"), passage_words=repeats.PASSAGE_WORDS)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words")


@query
def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under the mixed model, with the word-frequency base."""
    found = lm_scoring.score_texts(table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def document_path() -> Column:
    """Documents as files: most lie in a folder of fifty below source and language, some in the folders above."""
    depth = F.col("doc_id") % 10
    return F.concat_ws(
        "/", "source", F.when(depth > 0, F.col("lang")), F.when(depth > 1, F.expr("doc_id div 1000")),
        F.when(depth > 2, F.expr("doc_id div 50")), F.concat("doc_id", F.lit(".txt")))


_TEMPLATE_ROWS = ", ".join(f"({k}, '{name}', '{text}', '{needs}')" for k, (name, text, needs) in enumerate(licenses.TEMPLATES))
ORACLES["op4_licence_scan"] = rf"""
WITH templates AS (SELECT * FROM (VALUES {_TEMPLATE_ROWS}) AS t(template, licence, text, needs)),
files AS (
  SELECT doc_id, concat_ws('/', source, CASE WHEN doc_id % 10 > 0 THEN lang END, CASE WHEN doc_id % 10 > 1 THEN (doc_id // 1000)::VARCHAR END,
                   CASE WHEN doc_id % 10 > 2 THEN (doc_id // 50)::VARCHAR END) AS directory,
         list_distinct(list_filter(string_split(lower(coalesce(text, '')), chr(10)), lambda x: regexp_matches(x, '{licenses.SPEAKS}'))) AS lines
  FROM documents
), lines AS (SELECT doc_id, unnest(lines) AS line FROM files),
counted AS (SELECT line, count(*) AS n FROM lines GROUP BY line),
words AS (SELECT line, n, unnest(regexp_extract_all(line, '{licenses.WORD}')) AS word FROM counted),
template_words AS (SELECT template, licence, unnest(regexp_extract_all(lower(text), '{licenses.WORD}')) AS word FROM templates),
total AS (SELECT coalesce(sum(n), 0) + (SELECT count(*) FROM templates) AS total FROM counted),
idf AS (
  SELECT word, ln((1 + total) / (1 + sum(df))) + 1 AS idf FROM (
    SELECT word, sum(n) AS df FROM (SELECT DISTINCT line, n, word FROM words) GROUP BY word
    UNION ALL SELECT word, count(DISTINCT template) FROM template_words GROUP BY word), total
  GROUP BY word, total
), lw AS (SELECT line, word, count(*) * any_value(idf) AS w FROM words JOIN idf USING (word) GROUP BY line, word),
tw AS (SELECT template, licence, word, count(*) * any_value(idf) AS w FROM template_words JOIN idf USING (word) GROUP BY ALL),
ln_ AS (SELECT line, sqrt(sum(w * w)) AS norm FROM lw GROUP BY line),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY template),
dots AS (
  SELECT line, template, licence, round(sum(lw.w * tw.w) / (any_value(ln_.norm) * any_value(tn.norm)), 9) AS cosine
  FROM lw JOIN tw USING (word) JOIN ln_ USING (line) JOIN tn USING (template) GROUP BY line, template, licence
), named AS (
  SELECT line, licence, cosine FROM (
    SELECT d.*, string_split(needs, ' ') AS needs, regexp_extract_all(lower(text), '{licenses.WORD}') AS said, regexp_extract_all(line, '{licenses.WORD}') AS heard
    FROM dots d JOIN (SELECT template, text, needs FROM templates) USING (template))
  WHERE cosine >= {licenses.THRESHOLD} AND list_has_all(heard, needs)
    AND len(list_filter({list(licenses.MARKS)!r}, lambda m: list_contains(heard, m) <> list_contains(said, m))) = 0
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY cosine DESC, licence) = 1
), owned AS (
  SELECT doc_id, licence AS own FROM lines JOIN named USING (line)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, licence) = 1
), granted AS (
  SELECT directory AS from_directory, own AS granted FROM (
    SELECT directory, own, count(*) AS n FROM files JOIN owned USING (doc_id) GROUP BY directory, own)
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY n DESC, own) = 1
), near AS (
  SELECT f.directory, from_directory, granted FROM (SELECT DISTINCT directory FROM files) f
  JOIN granted g ON f.directory = g.from_directory OR starts_with(f.directory, g.from_directory || '/')
  QUALIFY row_number() OVER (PARTITION BY f.directory ORDER BY length(from_directory) DESC) = 1
)
SELECT f.doc_id, f.directory || '/' || f.doc_id || '.txt' AS path, own, coalesce(own, granted) AS licence,
       CASE WHEN own IS NULL THEN from_directory END AS from_directory
FROM files f LEFT JOIN owned o ON o.doc_id = f.doc_id LEFT JOIN near n ON n.directory = f.directory"""


@query
def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named and inherited licence of every document."""
    found = licenses.scan(table(spark, sf_dir, "documents"), document_path())
    return found.select(F.col("row.doc_id").alias("doc_id"), "path", "own", "licence", "from_directory")


ORACLES["op11_filter_audit"] = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), facts AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(w) < {filter_audit.LEAST_WORDS}, 100 * len(list_distinct(w)) < 50 * len(w),
          100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
          coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)] AS f
  FROM texts t LEFT JOIN facts ON facts.doc_id = t.doc_id
), tally AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, f
), orders AS (
  SELECT '' AS o UNION ALL SELECT o || x FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS t(x) WHERE NOT contains(o, x)
), steps AS (
  SELECT o, k AS step, list_transform(string_split(o[:k-1], ''), lambda x: ascii(x) - 64) AS before, ascii(o[k]) - 64 AS here
  FROM orders, range(1, 6) AS r(k) WHERE length(o) = 5
), counted AS (
  SELECT part, o, step, here,
         n, good, toxic, f[here] AS fails, len(list_filter(before, lambda k: k > 0 AND f[k])) > 0 AS gone,
         len(list_filter(f, lambda x: x)) = 1 AS alone
  FROM tally, steps
), summed AS (
  SELECT part, o AS filter_order, step::INTEGER AS step, here,
         coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails AND alone), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM counted GROUP BY part, o, step, here
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, here))::BIGINT AS shapley
FROM summed"""


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of all orders of the five filters, per language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_hard_negatives"] = """
WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM (SELECT * FROM valid WHERE vec_id % 100 = 0) a JOIN valid b ON a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5"""


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives just below the best rows of every anchor's own label."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with begin and end ids, and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.round_trip(docs, piece_model()).select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    from corpus_pipeline import run

    return run(spark, sf_dir)
