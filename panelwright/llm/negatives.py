"""Hard negatives by exact integer scores.

Scores are inner products of integer vectors. Component matrices are reduced modulo small primes and multiplied in float32,
where every sum stays exact; the signed score follows from its residues by Chinese remaindering. Anchors go through in blocks
of a fixed size: one pass over all rows finds the best rows of an anchor's own label, a second one the best other rows in the
score window below each of these. A task keeps only the best of each anchor while rows pass by.

Defined results: rows with a missing id, label or vector, or a missing or non-finite component take no part; a shorter vector
counts as if zeros followed; ties go to the smaller id; of rows with the same id one counts for each score it has with an anchor,
and rows of the anchor's id are neither its positives nor its negatives; an empty table, or one without anchors, gives no rows. Scores must
fit 56 bits, or the call ends with a ValueError before any is computed. Only the three named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import Stage, give_back

SCALE = 256
# Components multiplied before sums are reduced, and the bound of a sum that float32 holds with room to round.
INNER, EXACT = 256, 1 << 23
# Memory bounds: components of a broadcast block of anchors, scores held at once, rows cut from a batch.
BLOCK_COMPONENTS, HELD_SCORES, CUT_ROWS = 4 << 20, 1 << 20, 2048
FOUND = "anchor int, positive int, score long, id long"


def moduli(bound: int) -> list[int]:
    """Primes, largest first, whose product exceeds twice the bound; sums of ``INNER`` products of residues stay exact."""
    largest = 2 * int((EXACT / INNER) ** 0.5)
    primes = [p for p in range(largest, 2, -1) if all(p % q for q in range(2, int(p**0.5) + 1))]
    chosen, product = [], 1
    while product <= 2 * bound + 1:
        chosen.append(primes[len(chosen)])
        product *= chosen[-1]
    return chosen


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues nearest to zero, of whole float32 numbers below ``EXACT``."""
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


def residues(vectors: np.ndarray, primes: Sequence[int]) -> list[np.ndarray]:
    return [centred((vectors % p).astype(np.float32), p) for p in primes]


def exact_scores(left: list[np.ndarray], right: list[np.ndarray], primes: Sequence[int]) -> np.ndarray:
    """Signed inner products of all rows of two matrices, given by their residues."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        rest = np.zeros((len(left[k]), len(right[k])), np.float32)
        for a in range(0, left[k].shape[1], INNER):
            rest += centred(left[k][:, a : a + INNER] @ right[k][:, a : a + INNER].T, p)
            if a:
                rest = centred(rest, p)
        # Mixed-radix digits: what the digits before leave, divided by the product of their primes.
        weight = 1
        for digit, q in zip(digits, primes):
            rest -= digit * np.float32(weight % p)
            weight *= q
        rest = centred(rest, p)
        digits.append(centred(rest * np.float32(pow(weight % p, -1, p)), p) if k else rest)
    scores = np.zeros(rest.shape, np.int64)
    weight = 1
    for digit, p in zip(digits, primes):
        scores += digit.astype(np.int64) * weight
        weight *= p
    return scores


class Rows(NamedTuple):
    """Rows that take part: ids, labels and integer vectors of one width, in order of id."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


def rows_of(batch: pa.RecordBatch, width: int | None = None) -> tuple[Rows, float]:
    """The valid rows of a batch of ``(id, label, vector)``, and their largest component."""
    ids, labels, lists = batch.columns
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    row = np.repeat(np.arange(len(sizes)), sizes)
    good = np.bincount(row[~np.isfinite(values)], minlength=len(sizes)) == 0
    keep = good[row]
    largest = float(np.abs(values[keep]).max(initial=0))
    width = int(sizes.max(initial=0)) if width is None else width
    if largest >= 2.0**62:
        return Rows(*[np.zeros(0, np.int64)] * 2, np.zeros((0, width), np.int64)), largest
    vectors = np.zeros((len(sizes), width), np.int64)
    column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    vectors[row[keep], column[keep]] = values[keep].astype(np.int64)
    ids, labels = ids.to_numpy(zero_copy_only=False), labels.to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    order = order[good[order]]
    return Rows(ids[order], labels[order], vectors[order]), largest


class Best:
    """The first ``most`` of each group by falling score, then id, while candidates pass by."""

    def __init__(self, groups: int, most: int):
        self.most = most
        self.group, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # The score a candidate must reach.
        self.least = np.full(groups, np.iinfo(np.int64).min)

    def add(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ident = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, ident)))
        order = np.lexsort((ident, -score, group))
        group, score, ident = group[order], score[order], ident[order]
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]) | (score[1:] != score[:-1]) | (ident[1:] != ident[:-1])
        group, score, ident = group[new], score[new], ident[new]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        kept = place < self.most
        full = place == self.most - 1
        self.least[group[full]] = score[full]
        self.group, self.score, self.id = group[kept], score[kept], ident[kept]


def offered(best: Best, groups: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
    """Give the fitting cells of a score matrix (rows: ``groups``) that can be among the best."""
    fits &= scores >= best.least[groups][:, None]
    if fits.sum() > 64 * len(groups) and scores.shape[1] > best.most:
        lowest = np.iinfo(np.int64).min
        masked = np.where(fits, scores, lowest)
        fits &= scores >= np.partition(masked, -best.most, axis=1)[:, -best.most][:, None]
    row, column = np.nonzero(fits)
    best.add(groups[row], scores[row, column], ids[column])


class Block(NamedTuple):
    """A block of anchors as tasks get it."""

    rows: Rows
    primes: list[int]


def _scan(data: DataFrame, shared, width: int, most: int, windows=None, low: int = 0, high: int = 0) -> DataFrame:
    """Per task: the best rows of an anchor's label, or of other labels in the windows of its positives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        anchors, primes = block.rows, block.primes
        positives = windows.value if windows is not None else None
        per_anchor = 1 if positives is None else positives.shape[1]
        best = Best(len(anchors.ids) * per_anchor, most)
        parts = [np.arange(a, min(a + HELD_SCORES // CUT_ROWS, len(anchors.ids)))
                 for a in range(0, len(anchors.ids), HELD_SCORES // CUT_ROWS)]
        left = [residues(anchors.vectors[part], primes) for part in parts]
        for batch in batches:
            for start in range(0, batch.num_rows, CUT_ROWS):
                rows, _ = rows_of(batch.slice(start, CUT_ROWS), width)
                if not len(rows.ids):
                    continue
                right = residues(rows.vectors, primes)
                for part, reduced in zip(parts, left):
                    scores = exact_scores(reduced, right, primes)
                    same = anchors.labels[part][:, None] == rows.labels[None, :]
                    other_id = anchors.ids[part][:, None] != rows.ids[None, :]
                    if positives is None:
                        offered(best, part, scores, same & other_id, rows.ids)
                        continue
                    may = ~same & other_id
                    for k in range(per_anchor):
                        here = np.flatnonzero(positives[part, k, 0] == 1)
                        if len(here):
                            top = positives[part[here], k, 1][:, None]
                            found = scores[here]
                            fits = may[here] & (100 * found <= high * top) & (100 * found >= low * top)
                            offered(best, part[here] * per_anchor + k, found, fits, rows.ids)
        yield pa.RecordBatch.from_arrays([
            pa.array(best.group // per_anchor, pa.int32()), pa.array(best.group % per_anchor, pa.int32()),
            pa.array(best.score, pa.int64()), pa.array(best.id, pa.int64())], names=["anchor", "positive", "score", "id"])
        give_back()

    return data.mapInArrow(run, FOUND)


def _ranked(found: DataFrame, most: int) -> DataFrame:
    """The first of each anchor and positive over all tasks, ``place`` from 1."""
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id")
    return found.distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def facts_of(data: DataFrame) -> tuple[int, int, float]:
    """Anchors, longest vector and largest component of ``(id, label, vector, anchor)`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, width, largest = 0, 0, 0.0
        for batch in batches:
            width = max(width, pc.max(pc.list_value_length(batch.column(2))).as_py() or 0)
            anchors += pc.sum(batch.column(3)).as_py() or 0
            largest = max(largest, rows_of(batch.select([0, 1, 2]))[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([anchors], pa.int64()), pa.array([width], pa.int32()), pa.array([largest], pa.float64())],
            names=["anchors", "width", "largest"])

    row = data.mapInArrow(run, "anchors long, width int, largest double").agg(F.sum("anchors"), F.max("width"), F.max("largest")).first()
    return row[0] or 0, row[1] or 0, row[2] or 0.0


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    ident: str = "vec_id", label: str = "label", vector: str = "embedding",
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    An anchor's positives are its first rows of the same label; the negatives of each are the first rows of other labels
    with ``low`` % of the positive's score <= score <= ``high`` % of it.
    """
    spark = rows.sparkSession
    data = rows.select(
        F.col(ident).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"), anchor.alias("anchor"),
    ).filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    count, width, largest = facts_of(data.withColumn("anchor", F.coalesce(F.col("anchor"), F.lit(False)).cast("int")))
    bound = int(largest) ** 2 * width
    if bound >= 1 << 56:
        raise ValueError(f"scores up to {bound} do not fit 56 bits")
    blocks = -(-count * max(width, 1) // BLOCK_COMPONENTS)
    data, asked = data.select("id", "label", "vector"), data.filter("anchor").select("id", "label", "vector").distinct()
    primes = moduli(bound)
    queries = Stage(asked.withColumn("block", F.pmod(F.xxhash64("id", "label", "vector"), F.lit(max(blocks, 1))).cast("int")), "anchors", ("block",))
    results = []
    for number in range(blocks):
        batch = queries.read().filter(F.col("block") == number).select("id", "label", "vector").toArrow().combine_chunks()
        if not batch.num_rows:
            continue
        anchors, _ = rows_of(batch.to_batches()[0], width)
        shared = spark.sparkContext.broadcast(Block(anchors, primes))
        first = _ranked(_scan(data, shared, width, positives), positives).toArrow()
        window = np.zeros((len(anchors.ids), positives, 3), np.int64)
        window[first["anchor"].to_numpy(), first["place"].to_numpy() - 1] = np.stack(
            [np.ones(first.num_rows, np.int64), first["score"].to_numpy(), first["id"].to_numpy()], axis=1)
        windows = spark.sparkContext.broadcast(window)
        found = _ranked(_scan(data, shared, width, negatives, windows, low, high), negatives)
        names = spark.createDataFrame(pa.table({
            "anchor": pa.array(np.repeat(np.arange(len(anchors.ids)), positives), pa.int32()),
            "positive": pa.array(np.tile(np.arange(positives), len(anchors.ids)), pa.int32()),
            "anchor_id": np.repeat(anchors.ids, positives), "positive_id": window[:, :, 2].ravel(),
            "positive_score": window[:, :, 1].ravel()}))
        results.append(Stage(found.join(F.broadcast(names), ["anchor", "positive"]).select(
            "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")), "negatives"))
        shared.unpersist()
        windows.unpersist()
    queries.drop()
    if not results:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.schema(results[0].schema).parquet(*[r.path for r in results])
