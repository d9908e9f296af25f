"""Language-model scores by online logistic context mixing.

A text is its lower-case bytes and an end symbol; a byte is a walk down a fixed binary code, one bit per node. Each
predictor has a context (the last byte, the last two or four, or the word so far) and counts the zeros and ones seen
at each node there in the training texts. Every predictor gives the log odds of a one; gates, open where a long context
is known, add their own weights to those that mix them. Inside a text the weights are refined online:
after every bit they move along the gradient of its coding cost, so a text's score depends on the counts and
on the text alone, not on how texts are dealt to tasks. The texts of a chunk are walked side by side, bit by bit.

Distinct texts are dealt to chunks by length class and digest. One- and two-byte contexts have a bounded number of nodes, so each node
has a slot of its own in a table that is broadcast. Four-byte and word contexts grow with the corpus and are never
broadcast: every chunk sends its distinct (context, symbol) pairs with their training counts to buckets by context,
where they are summed, and the log odds of each pair's walk go back to the chunks that asked. Words of the base score
go the same way.

Defined results: a missing text counts as an empty one, which has the end symbol only; a missing id counts as an
empty one when texts are held out; repeated rows are trained on and scored each; equal texts have equal scores; with no training
texts every bit costs one bit and the base score is that of an empty table. Words are compared by 64-bit hashes,
long contexts by 56-bit hashes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import Stage, binary_buffers, give_back, row_pieces, shuffle_cleanup, text_digest, whole_text
from panelwright.llm.words import BASE, LOWER, words_of

END = 255  # never part of UTF-8
# Bytes by how common they are in Western text; the rest follow. Only the length of the walks depends on it.
COMMON = b" etaoinsrhldcumfpgwybv\xc3k.,\na-'\"x|!q0123456789j:z\xa9\xa8\xbc\xb3\xb1\xad\xa1"
# Contexts with slots of their own (two bytes and a node), and those that are joined.
SLOT_BITS = 24
ORDERS = ("one", "two")
LONG_ORDERS = ("four", "word")
# Weights at a text's start, and what an open gate (four bytes known, word known) adds.
FIRST_WEIGHTS = ((0.2, 0.4, 0.4, 0.4), (0.0, -0.2, 0.1, 0.0), (0.0, -0.1, 0.0, 0.1))
RATE = 0.08
MOST = 14.0  # log odds of a bit
PRIOR = 0.4
SCALE = 256  # of log odds in the tables
RUNS = (1,)  # bits after which the weights move
# Texts that are walked side by side, their bits or symbols, the bits that they go on together, and the lanes times steps
# whose terms are made at once.
SIDE_TEXTS, SIDE_BITS, STEPS = 1024, 3 << 20, 64
HELD_TERMS = 1 << 13
# Bytes of text whose distinct contexts are asked for together, and sizes from which texts are kept apart in chunks.
CHUNK_BYTES = 16 << 20
SIZE_EDGES = tuple(1 << k for k in range(14, 31, 2))
COUNT_PIECE_BYTES = 1 << 19
HELD_PAIRS = 1 << 20
WORD_PIECE_BYTES = 4 << 20
RANGE_BITS = 16
MERGED_AT_ONCE = 64
SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False
END_WORD = np.uint64(0x5851F42D4C957F2D)


@lru_cache(maxsize=1)
def code_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of each byte's walk, and the nodes and bits of all walks in a row; the code of weights that fall
    with the place in ``COMMON``."""
    order = [*dict.fromkeys(COMMON), END]
    order += [b for b in range(256) if b not in order]
    weight = {b: math.exp(-k / 7) + 2e-4 for k, b in enumerate(order)}
    heap = [(w, b, b) for b, w in weight.items()]
    heapq.heapify(heap)
    node = 0
    while len(heap) > 1:
        (w1, _, a), (w2, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (w1 + w2, 256 + node, (node, a, b)))
        node += 1
    walks: dict[int, list[tuple[int, int]]] = {}
    waiting = [(heap[0][2], [])]
    while waiting:
        tree, walk = waiting.pop()
        if isinstance(tree, tuple):
            name, a, b = tree
            waiting += [(a, [*walk, (name, 0)]), (b, [*walk, (name, 1)])]
        else:
            walks[tree] = walk
    lengths = np.array([len(walks[b]) for b in range(256)])
    steps = [step for b in range(256) for step in walks[b]]
    nodes = np.array([name for name, _ in steps], np.uint32)
    return lengths, nodes, np.array([bit for _, bit in steps], np.uint32)


@lru_cache(maxsize=1)
def _wide_code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths, nodes, bits = code_table()
    return lengths, nodes.astype(np.intp), bits


def _mixed(row: np.ndarray) -> np.ndarray:
    row = (row ^ (row >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    row = (row ^ (row >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return row ^ (row >> np.uint64(31))


def contexts(joined: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Symbols of all texts with their ends, the short contexts, the long contexts' hashes with the symbol in the lowest
    byte, and where each text begins."""
    n_texts = len(offsets) - 1
    starts = offsets[:-1] + np.arange(n_texts)
    symbols = np.full(len(joined) + n_texts, END, np.uint8)
    symbols[np.arange(len(joined)) + np.repeat(np.arange(n_texts), np.diff(offsets))] = LOWER[joined]
    n = len(symbols)
    inside = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))

    def back(k: int) -> np.ndarray:
        row = np.zeros(n, np.uint32)
        row[k:] = symbols[:-k]
        row[inside < k] = 0
        return row

    one, two, three, four = (back(k) for k in (1, 2, 3, 4))
    # The word so far: bytes since the last gap, as differences of running sums.
    gap = ~SPACE[one.astype(np.uint8)] | (inside == 0)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(7)) * _powers(n), dtype=np.uint64, out=sums[1:])
    begin = np.maximum.accumulate(np.where(gap, np.arange(n), 0))
    word = (sums[:-1] - sums[begin]) * _inverse(n)[begin]
    pair = one | two << np.uint32(8)
    long = [
        (pair | three << np.uint32(16) | four << np.uint32(24)).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15),
        _mixed(word) + np.uint64(0x3C6EF372FE94F82A),
    ]
    return symbols, [one, pair], [_mixed(h) & np.uint64(0xFFFFFFFFFFFFFF00) | symbols for h in long], starts


def _row_of_powers(base: int, n: int) -> np.ndarray:
    row = np.full(n, base, np.uint64)
    row[:1] = 1
    return np.multiply.accumulate(row, dtype=np.uint64)


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    return _row_of_powers(BASE, n)


@lru_cache(maxsize=4)
def _inverse(n: int) -> np.ndarray:
    return _row_of_powers(pow(BASE, -1, 1 << 64), n)


def walks_of(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the symbols' walks, where each begins among all their bits, and the place of every bit in the code."""
    lengths = code_table()[0]
    counts = lengths[symbols]
    bounds = np.concatenate([[0], np.cumsum(counts)])
    walk = (np.cumsum(lengths) - lengths)[symbols]
    return counts, bounds, np.repeat(walk - bounds[:-1], counts) + np.arange(bounds[-1])


def _packed(row: np.ndarray) -> bytes:
    """A row of numbers by byte place, compressed."""
    return pa.Codec("zstd", compression_level=1).compress(
        np.ascontiguousarray(row.view(np.uint8).reshape(-1, row.itemsize).T).tobytes(), asbytes=True)


def _unpacked(packed: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed, n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


class Pairs:
    """Distinct (context, symbol) pairs of many pieces and their training counts."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = self.most = 0

    def add(self, keys: np.ndarray, weight: np.ndarray) -> None:
        # Most texts count once or not at all: their pairs are counted by their runs in order.
        once, never = weight == 1, weight == 0
        for used in (once, never):
            row = np.sort(keys[used])
            edges = np.flatnonzero(np.concatenate([[len(row) > 0], row[1:] != row[:-1], [True]]))
            self.keys.append(row[edges[:-1]])
            self.counts.append(np.diff(edges) if used is once else np.zeros(max(len(edges) - 1, 0), np.int64))
        rest = ~(once | never)
        coded = pa.array(keys[rest]).dictionary_encode()
        self.keys.append(coded.dictionary.to_numpy())
        self.counts.append(np.bincount(coded.indices.to_numpy(), weights=weight[rest], minlength=len(coded.dictionary)))
        self.held += sum(map(len, self.keys[-3:]))
        if self.held > max(HELD_PAIRS, 2 * self.most):
            self.summed()

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs in order and their counts."""
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        self.keys, self.counts = [keys[first]], [np.add.reduceat(counts, first)]
        self.held = self.most = len(first)
        return self.keys[0], self.counts[0]


def _counters(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counter places of short contexts, twice the slot and the bit, and their counts."""
    used = counts > 0
    keys, counts = keys[used].astype(np.int64), counts[used]
    _, nodes, bits = code_table()
    n, _, at = walks_of((keys & 0xFF).astype(np.uint8))
    places, back = np.unique((np.repeat(keys >> 8, n) << 8 | nodes[at]) << 1 | bits[at], return_inverse=True)
    return places, np.bincount(back, weights=np.repeat(counts, n), minlength=len(places)).astype(np.int64)


def used_ranges(order: int, places: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    """Sorted counter places and their counts, by slot range."""
    parts = places >> (RANGE_BITS + 1)
    cuts = np.append(np.flatnonzero(np.append(True, parts[1:] != parts[:-1])), len(parts)) if len(parts) else []
    for a, b in zip(cuts, cuts[1:]):
        part = int(parts[a])
        yield (order << 16 | part, (places[a:b] - (part << (RANGE_BITS + 1))).astype("<u4").tobytes(),
               counts[a:b].astype("<u8").tobytes())


def used_slots(order: int, table: np.ndarray) -> Iterator[tuple]:
    """The used part of a table by slot range: counter places and their counts."""
    places = np.flatnonzero(table)
    return used_ranges(order, places, table[places])


PARTS = "kind string, key bigint, piece bigint, a binary, b binary, c binary"
PART_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
PART_NAMES = ["kind", "key", "piece", "a", "b", "c"]


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), PART_KINDS)], names=PART_NAMES)


def _bucket_cuts(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes; the highest 32 bits decide."""
    buckets = ((hashes >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    return np.searchsorted(buckets, np.arange(n_buckets + 1).astype(np.uint64))


def _word_parts(batch: pa.RecordBatch, piece: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct words of a piece by bucket with their training counts, and its texts as places of those words."""
    weight = batch.column(1).to_numpy()
    joined, offsets = binary_buffers(batch.column(0))
    words = words_of(joined, offsets, SPACE)
    n_texts = batch.num_rows
    hashes = np.append(words.hashes, np.full(n_texts, END_WORD))
    text = np.append(words.text, np.arange(n_texts))
    coded = pa.array(hashes).dictionary_encode()
    values = coded.dictionary.to_numpy()
    order = np.argsort(values)
    distinct, back = values[order], np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    place = back[coded.indices.to_numpy()]
    trained = np.bincount(place, weights=weight[text], minlength=len(distinct)).astype("<u4")
    cuts = _bucket_cuts(distinct, n_buckets)
    yield _parts([
        ("words", k, piece, distinct[a:b].tobytes(), trained[a:b].tobytes(), int(a).to_bytes(8, "little"))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a
    ])
    # The order of words does not matter here: sorted places, as steps, take the least room.
    both = np.sort(text << 32 | place)
    edges = np.searchsorted(both >> 32, np.arange(n_texts + 1))
    places = both & 0xFFFFFFFF
    digests = batch.column(2).to_pylist()
    yield _parts([("texts", 0, piece, digest, np.diff(places[a:b], prepend=0).astype("<u4").tobytes(), None)
                  for digest, a, b in zip(digests, edges, edges[1:])])


def chunk_pairs(batch: pa.RecordBatch) -> tuple[Pairs, Pairs]:
    """A chunk's pairs of the two-byte order, and those of all long orders."""
    two, long = Pairs(), Pairs()
    for part in row_pieces(iter([batch]), 0, COUNT_PIECE_BYTES):
        symbols, pairs, keys, starts = contexts(*binary_buffers(part.column(0)))
        weight = np.repeat(part.column(1).to_numpy(), np.diff(np.append(starts, len(symbols))))
        two.add(pairs[-1] << np.uint32(8) | symbols, weight)
        for key in keys:
            long.add(key, weight)
    return two, long


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])]


def long_keys(batch: pa.RecordBatch) -> np.ndarray:
    """The distinct pairs of all long orders in a chunk, in order, as :func:`chunk_pairs` finds them."""
    held: list[np.ndarray] = []
    for part in row_pieces(iter([batch]), 0, COUNT_PIECE_BYTES):
        held.append(_distinct(np.concatenate(contexts(*binary_buffers(part.column(0)))[2])))
        if sum(map(len, held[1:])) > max(HELD_PAIRS, 2 * len(held[0])):
            held = [_distinct(np.concatenate(held))]
    return _distinct(np.concatenate(held))


def short_totals(two: Pairs) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs and counts of the short orders: those of one byte are sums over the byte before."""
    keys, counts = two.summed()
    one = np.bincount(keys & np.uint32(0xFFFF), weights=counts, minlength=1 << 16)
    seen = np.flatnonzero(one)
    return [(seen.astype(keys.dtype), one[seen]), (keys, counts)]


def _context_parts(batch: pa.RecordBatch, chunk: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Counters of a chunk's short contexts, and its distinct long contexts and symbols by bucket, as steps."""
    two, long = chunk_pairs(batch)
    out = [("slots", key, 0, places, counts, None) for order, total in enumerate(short_totals(two))
           for key, places, counts in used_ranges(order, *_counters(*total))]
    distinct, trained = long.summed()
    trained = trained.astype("<u4")
    cuts = _bucket_cuts(distinct, n_buckets)
    out += [("asks", k, chunk, _packed(np.diff(distinct[a:b], prepend=np.uint64(0))), _packed(trained[a:b]),
             int(b - a).to_bytes(8, "little")) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    for start in range(0, len(out), 16):
        yield _parts(out[start : start + 16])


def gathered(texts: DataFrame, n_buckets: int) -> DataFrame:
    """All the corpus gives to the model, in one pass: context counts, word counts and coded texts.

    ``texts`` is ``(text, n_train, digest, chunk)`` of distinct texts.
    """
    def run(table: pa.Table) -> pa.Table:
        out = []
        batch = table.combine_chunks().to_batches()[0]
        for part in row_pieces(iter([batch]), 0, WORD_PIECE_BYTES):
            out += _word_parts(part, int.from_bytes(np.random.default_rng().bytes(7), "little"), n_buckets)
        out += _context_parts(batch, batch.column(3)[0].as_py(), n_buckets)
        give_back()
        return pa.Table.from_batches(out)

    return texts.groupBy("chunk").applyInArrow(run, PARTS)


def _summed(batches: Iterator[pa.RecordBatch]) -> tuple[int, np.ndarray]:
    total, key = np.zeros(2 << RANGE_BITS, np.int64), 0
    for batch in batches:
        key = batch.column("key")[0].as_py()
        for places, counts in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            total[np.frombuffer(places, "<u4")] += np.frombuffer(counts, "<u8").astype(np.int64)
    return key, total


def _partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, total = _summed(batches)
    places = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array([key], pa.int64()), pa.array([places.astype("<u4").tobytes()], pa.binary()),
         pa.array([total[places].astype("<u8").tobytes()], pa.binary())], names=["key", "a", "b"])


def log_odds(total: np.ndarray) -> np.ndarray:
    """The log odds of a one in every slot of a range; zero where nothing was seen."""
    zeros, ones = total[::2], total[1::2]
    odds = np.log((ones + PRIOR) / (zeros + PRIOR)) * SCALE
    return np.clip(np.rint(odds), -32767, 32767).astype("<i2")


def _finally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, total = _summed(batches)
    yield pa.RecordBatch.from_arrays(
        [pa.array([key], pa.int64()), pa.array([log_odds(total).tobytes()], pa.binary())], names=["key", "odds"])


def context_tables(parts: DataFrame, tasks: int) -> np.ndarray:
    """The log-odds tables of all orders; their size is fixed. Many counting tasks are summed in rounds."""
    slots = parts.filter("kind = 'slots'").select("key", "a", "b")
    while tasks > MERGED_AT_ONCE:
        tasks = math.ceil(tasks / MERGED_AT_ONCE)
        salted = slots.withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.lit(tasks)))
        slots = Stage(salted.select("key", "a", "b", "salt").groupBy("key", "salt").applyInArrow(
            _partly, "key bigint, a binary, b binary"), "lm-slots").read()
    # Written before it is iterated: an iterator's query counts as ended, and its shuffle is cleaned, before its jobs run.
    done = Stage(slots.groupBy("key").applyInArrow(_finally, "key bigint, odds binary"), "lm-tables")
    tables = np.zeros((len(ORDERS), 1 << SLOT_BITS), np.int16)
    for r in done.read().toLocalIterator():
        part = r["key"] & 0xFFFF
        tables[r["key"] >> 16, part << RANGE_BITS : (part + 1) << RANGE_BITS] = np.frombuffer(r["odds"], "<i2")
    done.drop()
    return tables


def moved(rows: np.ndarray, weights: np.ndarray, scale: float) -> np.ndarray:
    """The bits that each lane's next (step, lane, predictor) log odds cost; its weights move after every bit."""
    # Half the log odds give a chance by the hyperbolic tangent. The terms are scaled by the root of the step, the
    # weights by its inverse, so that what a term adds to its weight is the term times the chance of a miss.
    root = _root()
    steps, n, n_odds = rows.shape
    low, high, ones = np.float32(-0.25 / root), np.float32(1.0 / root), np.ones(n, np.float32)
    # No weight moves further than this, so most blocks stay clear of the bounds.
    reach = 2 * steps * scale * root * max(float(rows.max()), -float(rows.min()))
    bounded = float(weights.min()) - reach < low or float(weights.max()) + reach > high
    sums, miss, step = np.empty((steps, n), np.float32), np.empty(n, np.float32), np.empty(weights.shape, np.float32)
    # The terms of a few steps at a time stay in the processor's cache.
    few = min(max(HELD_TERMS // n, 1), steps)
    held = np.empty((few, len(FIRST_WEIGHTS), n_odds, n), np.float32)
    multiply, add, tanh, subtract, total = np.multiply, np.add, np.tanh, np.subtract, np.add.reduce
    for start in range(0, steps, few):
        part = rows[start : start + few].transpose(0, 2, 1)
        terms = held[: len(part)]
        multiply(part, np.float32(scale * root), out=terms[:, 0])
        for k in range(1, len(FIRST_WEIGHTS)):
            multiply(terms[:, 0], (terms[:, :1, len(ORDERS) + k - 1] != 0).astype(np.float32), out=terms[:, k])
        for term, z in zip(terms.reshape(-1, len(weights), n), sums[start:]):
            multiply(weights, term, step)
            total(step, 0, None, z)
            tanh(z, miss)
            subtract(ones, miss, miss)
            multiply(term, miss, step)
            add(weights, step, weights)
            if bounded:
                np.minimum(weights, high, out=weights)
                np.maximum(weights, low, out=weights)
    sums *= -2
    np.clip(sums, -MOST, MOST, out=sums)
    np.exp(sums, out=sums)
    sums += np.float32(1)
    # No product of 32 chances leaves the range of a double.
    return np.log2(np.multiply.reduceat(sums, np.arange(0, steps, 32), axis=0, dtype=np.float64)).sum(axis=0)


def _root() -> float:
    return math.sqrt(RATE / (RUNS[-1] + 256) / 4)


def bit_rows(pool: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next (step, lane, predictor) log odds of lanes whose texts are (predictor, bit), zero behind a text's end;
    how many places each lane goes on, and how many bits that is."""
    n = np.minimum(end - at, STEPS)
    places = at[:, None] + np.arange(int(n.max()))
    inside = places < end[:, None]
    rows = np.where(inside, pool[:, np.where(inside, places, 0)], pool.dtype.type(0))
    return np.ascontiguousarray(rows.transpose(2, 1, 0)), n, n


def mixed_scores(texts: Iterator[np.ndarray], scale: float, rows_of=bit_rows) -> list[float]:
    """The log2 probabilities of texts in their order; the weights of a text move after every bit.

    A text is (predictor, bit), the log odds of what came, or any (row, place) of which ``rows_of`` makes them; the gate of
    a long context is open where they are not zero.
    The weights of a bit are the first row, plus the rows of the gates that are open there. Texts are walked side by side
    and never touch each other; those that have ended make room for the next.
    """
    first = (np.array(FIRST_WEIGHTS).reshape(-1, 1) / (2 * _root())).astype(np.float32)
    found: list[float] = []
    number = at = end = np.empty(0, np.int64)
    weights = np.empty((len(first), 0), np.float32)
    coming = next(texts, None)
    pool = None
    gone = used = 0
    while len(number) or coming is not None:
        if coming is not None and (8 * gone >= len(number) or 4 * used >= SIDE_BITS):
            # What is left moves to the front, in order; texts that come next are held behind it.
            held = 0
            for k, (a, b) in enumerate(zip(at.tolist(), end.tolist())):
                pool[:, held : held + b - a] = pool[:, a:b]
                at[k], end[k] = held, held + b - a
                held += b - a
            fresh = []
            while coming is not None and len(number) + len(fresh) < SIDE_TEXTS and (
                    held + coming.shape[1] <= SIDE_BITS or not len(number) + len(fresh)):
                if pool is None or held + coming.shape[1] > pool.shape[1]:
                    pool = np.zeros((len(coming), max(SIDE_BITS, coming.shape[1])), coming.dtype)
                pool[:, held : held + coming.shape[1]] = coming
                fresh.append((len(found), held, held + coming.shape[1]))
                held += coming.shape[1]
                found.append(0.0)
                coming = next(texts, None)
            number, at, end = (np.append(x, np.array(y, np.int64)) for x, y in zip(
                (number, at, end), zip(*fresh) if fresh else ((), (), ())))
            weights = np.concatenate([weights, np.repeat(first, len(fresh), axis=1)], axis=1)
            gone = used = 0
        rows, places, bits = rows_of(pool, at, end)
        if len(number) == 1:
            # One text alone gets an empty lane beside it: sums are then taken in the same order in any company.
            rows, weights = np.concatenate([rows, 0 * rows], axis=1), np.concatenate([weights, first], axis=1)
        # A bit behind the end costs one.
        cost = moved(rows, weights, scale)[: len(number)] - (len(rows) - bits)
        for k, lost in zip(number.tolist(), cost.tolist()):
            found[k] -= lost
        at = at + places
        used += int(places.sum())
        stay = np.flatnonzero(at < end)
        gone += len(number) - len(stay)
        number, at, end, weights = number[stay], at[stay], end[stay], np.ascontiguousarray(weights[:, stay])
    return found


def mixed_score(sign: np.ndarray, odds: np.ndarray, gates: np.ndarray) -> float:
    """The log2 probability of one text's bits; behind a closed gate the log odds are zero."""
    odds = np.concatenate([odds[: len(ORDERS)], odds[len(ORDERS) :] * gates])
    return mixed_scores(iter([odds * sign]), 1.0)[0]


def pair_odds(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The log odds along the walks of sorted distinct (context, symbol) pairs, all walks in a row; zero only at nodes
    that were not seen."""
    _, nodes, bits = code_table()
    n, _, at = walks_of((keys & np.uint64(0xFF)).astype(np.uint8))
    context = np.cumsum(np.append(False, (keys[1:] ^ keys[:-1]) > np.uint64(0xFF)))
    _, place = np.unique(np.repeat(context, n) << 8 | nodes[at], return_inverse=True)
    total = np.bincount(place << 1 | bits[at], weights=np.repeat(counts, n), minlength=2 * (int(place.max()) + 1))
    odds = log_odds(total)
    odds[(odds == 0) & (total[::2] + total[1::2] > 0)] = 1  # seen as often as not
    return odds[place]


def long_odds(parts: DataFrame) -> DataFrame:
    """``(chunk, bucket, n, odds)``: per bucket the pairs' counts are summed and the log odds sent to all that asked."""
    def run(table: pa.Table) -> pa.Table:
        sizes = [int.from_bytes(x, "little") for x in table.column("c").to_pylist()]
        keys = [np.cumsum(_unpacked(x, n, "<u8"), dtype=np.uint64) for x, n in zip(table.column("a").to_pylist(), sizes)]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([_unpacked(x, n, "<u4") for x, n in zip(table.column("b").to_pylist(), sizes)])
        odds = pair_odds(distinct, np.bincount(place, weights=counts, minlength=len(distinct)))
        n, bounds, _ = walks_of((distinct & np.uint64(0xFF)).astype(np.uint8))
        back, at = [], 0
        for asked in keys:
            mine = place[at : at + len(asked)]
            ends = np.cumsum(n[mine])
            walked = odds[np.repeat(bounds[mine] - ends + n[mine], n[mine]) + np.arange(ends[-1])]
            back.append((len(walked), _packed(walked)))
            at += len(asked)
        give_back()
        return pa.table({"chunk": table.column("piece"), "bucket": table.column("key"),
                         "n": pa.array([n for n, _ in back], pa.int64()), "odds": pa.array([x for _, x in back], pa.binary())})

    asks = parts.filter("kind = 'asks'").select("key", "piece", "a", "b", "c")
    return asks.groupBy("key").applyInArrow(run, "chunk bigint, bucket bigint, n bigint, odds binary")


class LongOdds:
    """The log odds that came back to a chunk: sorted pairs, and where the walk of each begins.

    A bit of a walk holds the log odds of what came under all predictors side by side, as :func:`moved` takes them: at
    first the pair's own as the last. A pair of the four-byte order decides the short contexts, too; it is told of them when
    it is first met, and its own come before the last then."""

    def __init__(self, keys: np.ndarray, odds: np.ndarray):
        self.keys = keys
        lengths, _, bits = code_table()
        n = lengths[(keys & np.uint64(0xFF)).astype(np.uint8)]
        self.first = (np.cumsum(n) - n).astype(np.uint32 if len(odds) < 1 << 32 else np.int64)
        self.bits = np.zeros(len(odds), np.int64)
        lanes = self.bits.view(np.int16).reshape(-1, 4)
        for a in range(0, len(keys), HELD_PAIRS // 4):
            symbols = (keys[a : a + HELD_PAIRS // 4] & np.uint64(0xFF)).astype(np.uint8)
            _, bounds, code = walks_of(symbols)
            part = slice(int(self.first[a]), int(self.first[a]) + int(bounds[-1]))
            lanes[part, 3] = odds[part] * (bits[code].astype(np.int16) * 2 - 1)
        self.told = np.zeros(len(keys), bool)

    def begins(self, keys: np.ndarray, pairs: np.ndarray | None = None, tables: list[np.ndarray] = ()) -> np.ndarray:
        """Where the walks of the keys begin; ``pairs`` are the two-byte contexts of keys of the four-byte order."""
        coded = pa.array(keys).dictionary_encode()
        values, indices = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        order = np.argsort(values)
        at = np.empty(len(values), np.int64)
        at[order] = np.searchsorted(self.keys, values[order])
        begins = self.first[at]
        if pairs is not None:
            fresh = np.flatnonzero(~self.told[at])
            place = np.empty(len(values), np.int64)
            place[indices] = np.arange(len(indices))
            self._tell(begins[fresh], (values[fresh] & np.uint64(0xFF)).astype(np.uint8), pairs[place[fresh]], tables)
            self.told[at[fresh]] = True
        return begins.take(indices)

    def _tell(self, begins: np.ndarray, symbols: np.ndarray, pairs: np.ndarray, tables: list[np.ndarray]) -> None:
        _, nodes, bits = _wide_code()
        counts, bounds, code = walks_of(symbols)
        where = np.repeat(begins.astype(np.int64) - bounds[:-1], counts) + np.arange(bounds[-1])
        short = np.repeat(pairs.astype(np.int64) << 8, counts) | nodes[code]
        sign = bits[code].astype(np.int16) * 2 - 1
        found = np.zeros((len(where), 4), np.int16)
        found[:, 0] = tables[0].take(short & 0xFFFF) * sign
        found[:, 1] = tables[1].take(short) * sign
        found[:, 2] = self.bits.view(np.int16).reshape(-1, 4)[where, 3]
        self.bits[where] = found.view(np.int64).ravel()


def scores(texts: pa.RecordBatch, tables: list[np.ndarray], known: LongOdds) -> np.ndarray:
    """log10 probabilities of the texts of the first column."""
    sizes = pa.compute.binary_length(texts.column(0)).to_numpy() + 1
    # Texts come in any order, but for the long ones, which begin early enough not to be walked alone at the end.
    most = max(int(sizes.max()), int(sizes.sum()) // SIDE_TEXTS)
    order = np.argsort(np.arange(len(sizes)) * (1 - sizes / most), kind="stable")

    def rows_of(pool: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return symbol_rows(pool, at, end, known.bits)

    found = np.empty(len(sizes))
    found[order] = mixed_scores(_text_symbols(texts, order, tables, known), 1.0 / SCALE, rows_of)
    return found * math.log10(2)


def _text_symbols(
    texts: pa.RecordBatch, order: np.ndarray, tables: list[np.ndarray], known: LongOdds
) -> Iterator[np.ndarray]:
    """The symbols of each text and where the walks of its long contexts begin, as :func:`symbol_rows` takes them."""
    taken = (texts.take(pa.array(order[k : k + SIDE_TEXTS])) for k in range(0, len(order), SIDE_TEXTS))
    for part in row_pieces(taken, 0, COUNT_PIECE_BYTES // 2):
        symbols, short, (four, word), starts = contexts(*binary_buffers(part.column(0)))
        places = np.stack([symbols, known.begins(four, short[-1], tables), known.begins(word)]).astype(known.first.dtype)
        del four, word
        for a, b in zip(starts, np.append(starts[1:], len(symbols))):
            yield places[:, a:b]


def symbol_rows(
    pool: np.ndarray, at: np.ndarray, end: np.ndarray, odds: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`bit_rows`, for texts that are symbols and where the walks of their long contexts begin: whole symbols, as
    many as fit into the steps."""
    lengths = code_table()[0]
    places = at[:, None] + np.arange(STEPS // 3)
    inside = places < end[:, None]
    counts = lengths.take(pool[0].take(np.where(inside, places, 0))) * inside
    after = np.cumsum(counts, axis=1)
    inside &= after <= STEPS
    going = inside.sum(axis=1)
    n = len(at)
    n_bits = after[np.arange(n), going - 1]
    places, counts, before = places[inside], counts[inside], (after - counts)[inside]
    # Every bit: where its log odds are, in the walk of either order, and where they go.
    bounds = np.cumsum(counts)
    gone, every = bounds - counts, np.arange(int(bounds[-1]))
    where = np.repeat(pool[1].take(places) - gone, counts)
    where += every
    found = odds.take(where)
    where = np.repeat(pool[2].take(places) - gone, counts)
    where += every
    found |= odds.take(where)
    rows = np.zeros((int(n_bits.max()), n), np.int64)
    where = np.repeat((before - gone) * n + np.repeat(np.arange(n), going), counts)
    every *= n
    where += every
    rows.ravel()[where] = found
    return rows.view(np.int16).reshape(len(rows), n, 4), going, n_bits


def _scored(texts: DataFrame, tables: np.ndarray, odds: DataFrame) -> DataFrame:
    """``(digest, score)`` of every distinct text."""
    packed = texts.sparkSession.sparkContext.broadcast([tables[0, : 1 << 16].copy(), tables[1]])

    def run(rows: pa.Table, back: pa.Table) -> pa.Table:
        batch = rows.combine_chunks().to_batches()[0]
        del rows  # the texts are held once
        # The chunk asked for its pairs in order, bucket by bucket.
        parts = sorted(zip(*(back.column(name).to_pylist() for name in ("bucket", "n", "odds"))))
        odds, at = np.empty(sum(n for _, n, _ in parts), np.int16), 0
        for _, n, part in parts:
            odds[at : at + n] = _unpacked(part, n, "<i2")
            at += n
        known = LongOdds(long_keys(batch), odds)
        del parts, part, back, odds
        give_back()
        found = scores(batch, packed.value, known)
        give_back()
        return pa.table({"digest": batch.column("digest"), "score": pa.array(found, pa.float64())})

    return texts.groupBy("chunk").cogroup(odds.groupBy("chunk")).applyInArrow(run, "digest binary, score double")


def word_totals(parts: DataFrame) -> DataFrame:
    """Per bucket: the sums of its words, sent back to every piece, and one row (piece NULL) with the bucket's totals."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["piece", "a", "b", "c"]).to_pylist()
        sizes = [len(r["b"]) // 4 for r in rows]
        distinct, place = np.unique(np.concatenate([np.frombuffer(r["a"], "<u8") for r in rows]), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([np.frombuffer(r["b"], "<u4") for r in rows])).astype("<i8")
        back, at = [], 0
        for r, n in zip(rows, sizes):
            back.append((r["piece"], r["c"], total[place[at : at + n]].astype("<i8").tobytes(), None, None))
            at += n
        back.append((None, None, None, int(total.sum()), int((total > 0).sum())))
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*back), kinds)], names=["piece", "first", "counts", "n", "v"])

    words = parts.filter("kind = 'words'").select("key", "piece", "a", "b", "c")
    return words.groupBy("key").applyInArrow(run, "piece bigint, first binary, counts binary, n bigint, v bigint")


def base_scores(parts: DataFrame, totals: DataFrame, n_all: int, n_distinct: int) -> DataFrame:
    """``(digest, n_tokens, n_known, base_score)`` of every distinct text."""
    floor = n_all + 0.1 * (n_distinct + 1)

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        back = {int.from_bytes(f, "little"): np.frombuffer(c, "<i8")
                for f, c in zip(counts.column("first").to_pylist(), counts.column("counts").to_pylist())}
        count = np.concatenate([back[k] for k in sorted(back)])
        cost = np.log10((count + 0.1) / floor)
        rows = [np.cumsum(np.frombuffer(b, "<u4"), dtype=np.int64) for b in texts.column("b").to_pylist()]
        return pa.table({
            "digest": texts.column("a"), "n_tokens": pa.array([len(r) for r in rows], pa.int64()),
            "n_known": pa.array([int((count[r] > 0).sum()) for r in rows], pa.int64()),
            "base_score": pa.array([float(cost[r].sum()) for r in rows], pa.float64()),
        })

    texts = parts.filter("kind = 'texts'").select("piece", "a", "b")
    found = texts.groupBy("piece").cogroup(totals.filter("piece IS NOT NULL").groupBy("piece")).applyInArrow(
        run, "digest binary, n_tokens bigint, n_known bigint, base_score double")
    return found


def size_class(size: Column) -> Column:
    """Texts of very different length are not walked side by side: the last ones would be walked almost alone."""
    return sum((F.when(size >= edge, 1).otherwise(0) for edge in SIZE_EDGES), F.lit(0))


def dealt(texts: DataFrame, sizes: dict[int, int], n_chunks: int) -> DataFrame:
    """``texts`` with ``chunk``: by digest, in chunks of one size class each, their number by the class's bytes."""
    total, first = max(sum(sizes.values()), 1), 0
    chunk = F.lit(None).cast("bigint")
    kind = size_class(F.octet_length("text"))
    for k, n_bytes in sorted(sizes.items()):
        n = max(math.ceil(n_chunks * n_bytes / total), 1)
        chunk = F.when(kind == k, F.pmod(F.xxhash64("digest"), F.lit(n)) + first).otherwise(chunk)
        first += n
    return texts.select("*", chunk.alias("chunk"))


def held_out(doc_id: Column) -> Column:
    """One text in ten is not trained on."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str = "row") -> DataFrame:
    """``(row, held_out, n_tokens, n_known, train_tokens, base_score, score)``; ``row`` is the input row without its text."""
    spark = docs.sparkSession
    content = whole_text(text).cast("binary")
    rows = docs.select(
        content.alias("text"), held_out(F.col(doc_id)).alias("held_out"), text_digest(content).alias("digest"),
        F.struct(*[F.col(c) for c in docs.columns if c != text]).alias(row))
    size = F.octet_length("text")
    sizes = {r[0]: r[1] for r in rows.groupBy(size_class(size)).agg(F.sum(size)).collect()}
    n_bytes = sum(sizes.values())
    n_chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), math.ceil(n_bytes / CHUNK_BYTES))
    with shuffle_cleanup(spark):
        texts = Stage(dealt(rows.groupBy("digest").agg(
            F.first("text").alias("text"), F.count_if(~F.col("held_out")).alias("n_train"),
        ).select("text", "n_train", "digest"), sizes, n_chunks), "lm-texts")
        gathered_parts = Stage(gathered(texts.read(), n_chunks), "lm-parts", ("kind",))
        parts = gathered_parts.read()
        totals = Stage(word_totals(parts), "lm-totals")
        sums = totals.read().filter("piece IS NULL").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
        n_all, n_distinct = sums["n"] or 0, sums["v"] or 0
        base = Stage(base_scores(parts, totals.read(), n_all, n_distinct), "lm-base").read()
        totals.drop()
        for kind in ("words", "texts"):
            gathered_parts.drop(f"kind={kind}")
        parts = gathered_parts.read()
        tables = context_tables(parts, n_chunks)
        gathered_parts.drop("kind=slots")
        odds = Stage(long_odds(gathered_parts.read()), "lm-odds")
        gathered_parts.drop()
        scored = Stage(_scored(texts.read(), tables, odds.read()), "lm-scores").read()
        texts.drop()
        odds.drop()
    scored = rows.select(row, "held_out", "digest").join(scored, "digest")
    return scored.join(base, "digest").select(
        row, "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
