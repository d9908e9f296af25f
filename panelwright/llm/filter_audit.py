"""Interaction audit of document filters by coalitions.

Each filter's verdict depends on the document (and, for copies, on the input table) alone, so a document is told by the set of
filters it fails. The documents of a part are counted by that set, the removals of all coalitions of filters are summed from
the counts, and everything else comes from the coalition table: a step of an order removes what the coalition with the step's
filter removes beyond the coalition before it, and the Shapley values solve the kernel-weighted least squares over all
coalitions whose values add up to the removal of all, in rationals.

Defined results: a missing text is empty and fails as such, a missing part is the empty text; a missing doc_id has no labels, is
a copy of nothing, and does not make another row a copy; equal doc_ids are no smaller than each other, so such rows are not copies
for one another; a document has a label if any row of the labels table says so, a missing label says no; very long texts are
judged whole; other columns, whatever their names, are not read; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import permutations
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import let, split_words, text_digest, whole_text

LEAST_WORDS = 200
STEP_SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def text_failures(text: Column) -> Column:
    """Filters A to D as bits 1, 2, 4 and 8: a text that fails a filter has its bit."""
    few_words = let(split_words(text), lambda words: let(F.size(words), lambda n: (
        F.when(n < LEAST_WORDS, 1).otherwise(0)
        + F.when(100 * F.size(F.array_distinct(words)) < 50 * n, 2).otherwise(0))))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return (
        few_words + F.when(100 * capitals > 3 * F.length(text), 4).otherwise(0)
        + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
    ).cast("int")


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``(part, failed, good, toxic, n)``: documents by the set of filters they fail; copies (E) have bit 16.

    No row moves with its text, and no key holds more than its partial sums: copies are counted by (text, part, labels)
    before the least id of a text meets them.
    """
    facts = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    text = whole_text()
    rows = docs.select(
        F.col("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        text_digest(text).alias("digest"), text_failures(text).alias("failed"))
    same = rows.groupBy("doc_id", "digest", "part", "failed").agg(F.count(F.lit(1)).alias("n"))
    told = same.join(facts, same["doc_id"] == facts["label_id"], "left").select(
        "doc_id", "digest", "part", "failed", "n",
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    named = F.col("doc_id").isNotNull()
    groups = told.groupBy("digest", "part", "failed", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("nameless"),
        F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"))
    least = groups.groupBy(F.col("digest").alias("least_digest")).agg(F.min("first.doc_id").alias("least_id"))
    copies = groups.join(least, F.col("digest") == F.col("least_digest")).select("part", "failed", "good", "toxic", "n", (
        F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least_id"), F.col("first.n")).otherwise(0)).alias("firsts"))
    both = F.explode(F.array(
        F.struct(F.col("failed"), F.col("firsts").alias("n")),
        F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - F.col("firsts")).alias("n"))))
    return copies.select("part", "good", "toxic", both.alias("c")).groupBy(
        "part", "good", "toxic", F.col("c.failed").alias("failed")).agg(F.sum("c.n").alias("n"))


def coalition_table(failed: DataFrame, filters: int) -> DataFrame:
    """``(part, n, coalitions)``: of each coalition, in order of its bits, ``(removed, good, toxic)``."""
    counted = failed.groupBy("part", "failed").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    pairs = counted.select("*", F.explode(F.sequence(F.lit(0), F.lit(2**filters - 1))).alias("coalition"))
    hit = F.col("failed").bitwiseAND(F.col("coalition")) != 0
    sums = pairs.groupBy("part", "coalition").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(to)
                                 for c, to in (("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))])
    row = F.struct("coalition", "removed", "good_lost", "toxic_lost")
    return sums.groupBy("part").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(row)).alias("coalitions"))


def solved(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """The solution of a square system by elimination in rationals."""
    n = len(right)
    rows = [[*line, value] for line, value in zip(matrix, right)]
    for k in range(n):
        pivot = next(r for r in range(k, n) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(n):
            if r != k and rows[r][k]:
                factor = rows[r][k]
                rows[r] = [x - factor * y for x, y in zip(rows[r], rows[k])]
    return [line[n] for line in rows]


def shapley_values(removed: Sequence[int], filters: int) -> list[Fraction]:
    """Shapley values of a game given by the value of every coalition (bits in order, the empty one first).

    They minimise the sum over the coalitions but the empty and the full one of weight(size) * (value - sum of the members')^2,
    with all values adding up to that of the full coalition; weight(s) = (m - 1) / (C(m, s) * s * (m - s)). The normal
    equations have one more unknown for that constraint.
    """
    members = [[s >> k & 1 for k in range(filters)] for s in range(2**filters)]
    matrix = [[Fraction(0)] * filters + [Fraction(1)] for _ in range(filters)] + [[Fraction(1)] * filters + [Fraction(0)]]
    right = [Fraction(0)] * filters + [Fraction(removed[-1])]
    for s in range(1, 2**filters - 1):
        size = sum(members[s])
        weight = Fraction(filters - 1, comb(filters, size) * size * (filters - size))
        inside = [k for k in range(filters) if members[s][k]]
        for i in inside:
            right[i] += weight * removed[s]
            for j in inside:
                matrix[i][j] += weight
    return solved(matrix, right)[:filters]


def order_steps(table: DataFrame, filters: str) -> DataFrame:
    """One row per part, order of the filters and step, from a coalition table."""
    m = len(filters)
    orders = list(permutations(range(m)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                removed, good, toxic = ([c[k] for c in part["coalitions"]] for k in ("removed", "good_lost", "toxic_lost"))
                values = shapley_values(removed, m)
                full = 2**m - 1
                found = []
                for order in orders:
                    name, before = "".join(filters[k] for k in order), 0
                    for step, k in enumerate(order, 1):
                        now = before | 1 << k
                        here = removed[now] - removed[before]
                        found.append((
                            part["part"], name, step, part["n"] - removed[now], here, removed[1 << k] - here,
                            removed[full] - removed[full ^ 1 << k], good[now] - good[before], toxic[now] - toxic[before],
                            int(values[k] * len(orders))))
                        before = now
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
                names = [f.split()[0] for f in STEP_SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found), kinds)], names=names)

    return table.mapInArrow(run, STEP_SCHEMA)


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """What every step of every order of the five filters removes, per part."""
    return order_steps(coalition_table(failures(docs, labels, part), 5), "ABCDE")
