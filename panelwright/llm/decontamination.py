"""Benchmark decontamination by an FM-index per training shard.

A shard is a run of texts of bounded size. Its words become symbols: every word of the benchmark has one, all other
words share one that no phrase holds, and every text ends with a separator. The suffixes of the symbol row are sorted
by prefix doubling; the Burrows-Wheeler row is kept as a wavelet tree of rank-counted bit rows, and every
``SAMPLE``-th position is kept to locate rows. All phrases are searched backwards at once, one symbol per step, each
step one rank on the tree. Rows of the found ranges walk back to a sampled position, and the spans they give are
merged per text. Words are compared by 64-bit hashes.

Phrases come in blocks of bounded size, so the broadcast does not grow with the benchmark; a large benchmark means
more passes over the shards.

Defined results: a missing text has no words; an item without words has no phrase; an item of fewer words than a window is one
phrase; repeated rows and ids are judged one by one; equal items all count; a missing item id counts as an empty
name; an empty benchmark hits nothing. Other columns are carried along in ``row``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import binary_buffers, give_back, row_pieces, whole_text
from panelwright.llm.words import Words, words_of

WINDOW = 10
SAMPLE = 8
SHARD_BYTES = 2 << 20
# Text bytes of the benchmark items that are searched together.
BLOCK_BYTES = 1 << 20

LETTER = np.zeros(256, bool)
LETTER[0x30:0x3A] = LETTER[0x61:0x7B] = LETTER[0x80:] = True


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling; only suffixes whose prefix is still shared are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranks = np.empty(n, np.int64)
    step = 1
    ordered = symbols[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    ranks[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    # Places in the order whose suffix shares its rank with another.
    sizes = np.diff(np.append(heads, n))
    tied = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    while len(tied):
        rows = order[tied]
        following = rows + step
        second = np.where(following < n, ranks[np.minimum(following, n - 1)], -1)
        first = ranks[rows]
        key = first * np.int64(n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        rows, key = rows[by], key[by]
        order[tied] = rows
        new = np.concatenate([[True], key[1:] != key[:-1]])
        heads = np.flatnonzero(new)
        counts = np.diff(np.append(heads, len(tied)))
        # The tied places of one rank are neighbours, so a new rank is the place of its first member.
        ranks[rows] = np.repeat(tied[heads], counts)
        tied = tied[np.repeat(counts, counts) > 1]
        step *= 2
    return order


class BitRow:
    """Bits with counts of the ones before every word of 64."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[at >> 6] + np.bitwise_count(self.words[at >> 6] & mask)


class FmIndex:
    """Wavelet tree over the Burrows-Wheeler row of a symbol row, with sampled positions."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        # A smallest symbol ends the row, so that every suffix order is total.
        row = np.append(symbols + 1, 0)
        n = len(row)
        order = suffix_order(row)
        last = row[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n_symbols + 1))])
        self.depth = max(1, int(n_symbols).bit_length())
        self.levels: list[BitRow] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.depth)):
            bits = (last >> level) & 1
            self.levels.append(BitRow(bits))
            self.zeros.append(int(n - bits.sum()))
            last = np.concatenate([last[bits == 0], last[bits == 1]])
        sampled = (order % SAMPLE == 0)
        self.sampled = BitRow(sampled)
        self.positions = order[sampled]
        self.n = n

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the Burrows-Wheeler row before each place."""
        start = np.zeros(len(at), np.int64)
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = ((symbol >> (self.depth - 1 - k)) & 1).astype(bool)
            ones_start, ones_at = bits.ones(start), bits.ones(at)
            start = np.where(one, zeros + ones_start, start - ones_start)
            at = np.where(one, zeros + ones_at, at - ones_at)
        return at - start

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, place = np.zeros(len(at), np.int64), at
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            one = bits.get(place).astype(bool)
            ones_start, ones_at = bits.ones(start), bits.ones(place)
            start = np.where(one, zeros + ones_start, start - ones_start)
            place = np.where(one, zeros + ones_at, place - ones_at)
            symbol = symbol * 2 + one
        return symbol, place - start

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose suffix begins with each phrase; phrases are rows of symbols, filled up on the right."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(phrases.shape[1]):
            at = lengths - 1 - back
            live = np.flatnonzero((at >= 0) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, at[live]] + 1
            low[live] = self.first[symbol] + self.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of each row, by steps back to a sampled one."""
        found = np.full(len(rows), -1, np.int64)
        waiting, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(waiting):
            hit = self.sampled.get(rows).astype(bool)
            found[waiting[hit]] = self.positions[self.sampled.ones(rows[hit])] + steps
            waiting, rows = waiting[~hit], rows[~hit]
            if len(waiting):
                symbol, rank = self.symbol_and_rank(rows)
                rows = self.first[symbol] + rank
            steps += 1
        return found


class Phrases(NamedTuple):
    """Distinct windows of a block of items, in symbols of the block's own words."""

    vocabulary: np.ndarray  # sorted word hashes; symbol k stands for the k-th
    windows: np.ndarray
    lengths: np.ndarray
    owners: list[list[str]]  # the items of each window


def phrases_of(items: list[tuple[str, bytes]], window: int = WINDOW) -> Phrases:
    offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in items])]).astype(np.int64)
    words = words_of(np.frombuffer(b"".join(t for _, t in items), np.uint8), offsets, LETTER)
    vocabulary, symbols = np.unique(words.hashes, return_inverse=True)
    found: dict[tuple[int, ...], dict[str, None]] = {}
    bounds = np.searchsorted(words.text, np.arange(len(items) + 1))
    for (name, _), start, end in zip(items, bounds, bounds[1:]):
        row = symbols[start:end].tolist()
        for k in range(max(1, len(row) - window + 1) if row else 0):
            found.setdefault(tuple(row[k : k + window]), {})[name] = None
    lengths = np.array([len(w) for w in found], np.int64)
    windows = np.zeros((len(found), window), np.int64)
    for k, w in enumerate(found):
        windows[k, : len(w)] = w
    return Phrases(vocabulary, windows, lengths, [list(o) for o in found.values()])


def hits(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, window) of every occurrence in the texts of one shard.

    Words outside the benchmark cannot be hit, so a run of them is one symbol in the index, and runs of benchmark
    words too short for any window are part of it.
    """
    none = (np.empty(0, np.int64),) * 3
    n_known = len(phrases.vocabulary)
    if not n_known or not len(words.hashes):
        return none
    at = np.minimum(np.searchsorted(phrases.vocabulary, words.hashes), n_known - 1)
    known = phrases.vocabulary[at] == words.hashes
    # Runs of known words within a text.
    fresh = np.concatenate([[True], words.text[1:] != words.text[:-1]])
    head = known & (fresh | np.concatenate([[True], ~known[:-1]]))
    run = np.cumsum(head) - 1
    sizes = np.bincount(run[known], minlength=int(head.sum())) if head.any() else np.empty(0, np.int64)
    kept = known.copy()
    kept[known] = sizes[run[known]] >= phrases.lengths.min()
    places = np.flatnonzero(kept)
    if not len(places):
        return none
    # A separator stands before every run; symbols of words come after the separator's.
    heads = head[places]
    spots = np.arange(len(places)) + np.cumsum(heads)
    symbols = np.zeros(len(places) + int(heads.sum()) + 1, np.int64)
    symbols[spots] = at[places] + 1
    origin = np.full(len(symbols), -1, np.int64)
    origin[spots] = places
    index = FmIndex(symbols, n_known + 1)
    low, high = index.search(phrases.windows + 1, phrases.lengths)
    counts = high - low
    which = np.repeat(np.arange(len(counts)), np.maximum(counts, 0))
    if not len(which):
        return none
    inside = np.arange(len(which)) - np.repeat(np.cumsum(np.maximum(counts, 0)) - np.maximum(counts, 0), np.maximum(counts, 0))
    first = origin[index.locate(low[which] + inside)]
    return first, phrases.lengths[which], which


SPANS = "array<struct<start:bigint,end:bigint>>"


def _covered(words: Words, offsets: np.ndarray, first: np.ndarray, length: np.ndarray, before: list) -> np.ndarray:
    """Which words lie in an occurrence, or in a span that an earlier block has found."""
    change = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + length, -1)
    for t, spans in enumerate(before):
        for span in spans or ():
            change[np.searchsorted(words.starts, offsets[t] + span["start"])] += 1
            change[np.searchsorted(words.starts, offsets[t] + span["end"])] -= 1
    return np.cumsum(change[:-1]) > 0


def _shard_rows(joined: np.ndarray, offsets: np.ndarray, phrases: Phrases, before: list, known: list) -> tuple:
    """Per text: words, hit words, merged spans in bytes, and the items that occur."""
    n = len(offsets) - 1
    words = words_of(joined, offsets, LETTER)
    bounds = np.searchsorted(words.text, np.arange(n + 1))
    first, length, which = hits(words, phrases)
    covered = _covered(words, offsets, first, length, before)
    total = np.concatenate([[0], np.cumsum(covered)])
    spans: list[list] = [[] for _ in range(n)]
    names = [set(x or ()) for x in known]
    if covered.any():
        cut = np.concatenate([[True], words.text[1:] != words.text[:-1]])
        begins = covered & (cut | ~np.concatenate([[False], covered[:-1]]))
        ends = covered & np.concatenate([cut[1:] | ~covered[1:], [True]])
        for a, b in zip(np.flatnonzero(begins), np.flatnonzero(ends)):
            t = int(words.text[a])
            spans[t].append({"start": int(words.starts[a] - offsets[t]), "end": int(words.ends[b] - offsets[t])})
    if len(first):
        pairs = np.unique(np.stack([words.text[first], which], axis=1), axis=0)
        for t, w in pairs.tolist():
            names[t].update(phrases.owners[w])
    return np.diff(bounds), total[bounds[1:]] - total[bounds[:-1]], spans, [sorted(x) for x in names]


def _pass(rows: DataFrame, block: list[tuple[str, bytes]], window: int) -> DataFrame:
    """The rows with what one block of items adds."""
    packed = rows.sparkSession.sparkContext.broadcast(pickle.dumps(phrases_of(block, window)))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def added(batch: pa.RecordBatch, phrases: Phrases) -> pa.RecordBatch:
        joined, offsets = binary_buffers(batch.column(1))
        n_words, n_hit, spans, items = _shard_rows(
            joined, offsets, phrases, batch.column("spans").to_pylist(), batch.column("items").to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
             pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], names=batch.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # No batch is held here any more when memory is given back.
        yield from map(partial(added, phrases=pickle.loads(packed.value)), row_pieces(batches, 1, SHARD_BYTES))
        give_back()

    return rows.mapInArrow(run, rows.schema)


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    named = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"),
                             whole_text(text).cast("binary").alias("text"))
    for item in named.toLocalIterator():
        if block and size + len(item["text"]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item["name"], bytes(item["text"])))
        size += len(item["text"])
    yield block


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(row, text, n_words, n_hit, spans, items)`` per document; spans are merged byte positions of the hit words,
    ``row`` is the input row without its text, ``text`` is binary.
    """
    result = docs.select(
        F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("row"),
        whole_text(text).cast("binary").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"), F.array().cast(SPANS).alias("spans"),
        F.array().cast("array<string>").alias("items"))
    for block in benchmark_blocks(benchmark, item_id, item_text, block_bytes):
        result = _pass(result, block, window)
    return result


def remove_spans(found: DataFrame) -> DataFrame:
    """``(row, text)`` without the hit spans, as text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for content, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts, at = [], 0
                for span in spans:
                    parts.append(content[at : span["start"]])
                    at = span["end"]
                texts.append((b"".join(parts) + content[at:]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    rows = found.select("row", "text", "spans")
    return rows.mapInArrow(run, rows.select("row", F.col("text").cast("string").alias("text")).schema)
