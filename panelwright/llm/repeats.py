"""Repeated substrings by fingerprint grouping, block by block, with the samples of a difference cover as a prefilter.

Bytes are removed that lie in a string of ``length`` bytes which also starts anywhere else. Of any two suffixes, one
offset below the cover's period puts both on cover positions, so two equal strings share a cover sample of
``length - period + 1`` bytes there. First the samples are ranked: samples whose rank no other shares are settled,
and so is every suffix without a tied sample in reach. Only the remaining suffixes are sorted, one block of buckets
at a time, by the fingerprint of their first ``length`` bytes; equal neighbours in a bucket are repeats. Only
equality to this depth matters, so ranks are fingerprints in place of alphabetical places.

What a task sends on is packed by piece (a run of whole texts) and bucket. A string that a piece holds twice is
settled there and sent once, so a passage that very many texts share costs one entry per piece. Blocks bound the disk
that one sort takes; their number follows from the bytes to sort and never changes the result. A false tie among
samples costs work only; suffixes are compared by 64 bits besides the bits of block and bucket.

Defined results: a missing text counts as an empty one; a text shorter than ``length`` keeps all its bytes; equal
texts of at least ``length`` bytes are repeats as a whole, repeated rows included; matches never cross texts.

Passages are measured in words, too, since some fifty words may have fewer than ``length`` bytes: a word is shared if it
lies in so many words in a row that another row has as well, A-Z lowered and however the words are set apart. Nothing is
removed for it. Windows of that many words are named by 64 bits and grouped by them, those only whose least short window
(samples again) another row has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import Stage, binary_buffers, give_back, row_pieces, shuffle_cleanup, text_digest, whole_text
from panelwright.llm.words import Words, words_of
from panelwright.llm.words import _powers as words_of_powers

LENGTH = 400
PASSAGE_WORDS = 50
PIECE_BYTES, PIECE_ROWS = 8 << 20, 65_000
# Every byte of a piece may start an open suffix, which takes some ninety bytes of a task while the piece is packed.
OPEN_BYTES = 2 << 20
# Text whose windows of words a task packs at once, and the bytes of a usual word with its gap.
PASSAGE_BYTES, WORD_BYTES = 2 << 20, 6
# Samples or suffixes of one bucket, and of one block.
BUCKET_ROWS = 2_000_000
# Bits of a text's number inside the partition that gave it.
NUMBER_BITS = 33
BLOCK_SUFFIXES = 40_000_000
SAMPLE_BASE, SUFFIX_BASE, BUCKET_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7
PASSAGE_BASE = 0xA0761D6478BD642F
PART = 1 << 20
LETTER = np.ones(256, bool)
LETTER[[0x20, *range(0x09, 0x0E)]] = False


@lru_cache(maxsize=8)
def difference_cover(length: int) -> tuple[int, tuple[int, ...]]:
    """Period and members: any difference modulo the period is that of two members.

    Strings of 289 bytes or more use the perfect cover of period 273, the orbits of 1, 91 and 117 under doubling;
    shorter ones a simple cover of small numbers and their multiples.
    """
    if length >= 289:
        return 273, tuple(sorted({start * 2**k % 273 for start in (1, 91, 117) for k in range(12)}))
    period = max(1, length // 2)
    root = int(np.ceil(np.sqrt(period)))
    return period, tuple(sorted({*range(root), *(k % period for k in range(0, period + root, root))}))


@lru_cache(maxsize=16)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    def row(b: int) -> np.ndarray:
        values = np.full(n, b, np.uint64)
        values[0] = 1
        return np.multiply.accumulate(values)

    return row(base), row(pow(base, -1, 1 << 64))


def fingerprints(data: np.ndarray, starts: np.ndarray, length: int, base: int) -> np.ndarray:
    """64-bit fingerprints of the strings of ``length`` bytes at sorted starts."""
    out = np.empty(len(starts), np.uint64)
    up, down = _powers(base, PART + length)
    first = 0
    while first < len(starts):
        a = int(starts[first])
        last = int(np.searchsorted(starts, a + PART, side="left"))
        b = int(starts[last - 1]) + length
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
        at = starts[first:last] - a
        out[first:last] = (sums[at + length] - sums[at]) * down[at]
        first = last
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(30)
    return out


def cover_samples(n: int, width: int, period: int, members: tuple[int, ...]) -> np.ndarray:
    """Cover positions of a text of n bytes at which a sample fits."""
    rounds = np.arange(0, max(0, n - width + 1), period)
    places = (rounds[:, None] + np.array(members)[None, :]).ravel()
    return places[places <= n - width]


def pieces_of(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of bounded bytes whose numbers, counted from the first, need two bytes."""
    for batch in row_pieces(batches, column, most_bytes):
        numbers = batch.column(0).to_numpy()
        start = 0
        while start < len(numbers):
            away = (numbers[start:] < numbers[start]) | (numbers[start:] >= numbers[start] + PIECE_ROWS)
            end = start + int(away.argmax()) if away.any() else len(numbers)
            yield batch.slice(start, end - start)
            start = end


PACKED = "bucket int, piece bigint, texts binary, places binary, names binary"
NAMES = ["bucket", "piece", "texts", "places", "names"]


def _row(bucket: int, piece: int, texts: np.ndarray, places: np.ndarray, names: np.ndarray, width: int) -> tuple:
    # The upper bytes of sorted names, one plane after another, compress best.
    planes = names.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() if len(names) else b""
    return bucket, piece, texts.astype("<u2").tobytes(), places.astype("<u4").tobytes(), planes


def packed_rows(
    piece: int, texts: np.ndarray, places: np.ndarray, names: np.ndarray, buckets: np.ndarray, n_buckets: int, width: int,
) -> pa.RecordBatch:
    """Entries by bucket; those that the piece settles itself have no names."""
    order = np.lexsort((names, buckets))
    texts, places, names, buckets = texts[order], places[order], names[order], buckets[order]
    same = (names[1:] == names[:-1]) & (buckets[1:] == buckets[:-1])
    follows = np.concatenate([[False], same])
    leads = np.concatenate([same, [False]])
    settled = follows | leads
    rows = []
    if settled.any():
        rows.append(_row(piece % n_buckets, piece, texts[settled], places[settled], names[:0], width))
    # A name that the piece holds twice is sent twice, so that a single one elsewhere meets it.
    sent = np.repeat(np.flatnonzero(~follows), np.where(leads[~follows], 2, 1))
    texts, places, names, buckets = texts[sent], places[sent], names[sent], buckets[sent]
    edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            rows.append(_row(int(buckets[a]), piece, texts[a:b], places[a:b], names[a:b], width))
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=NAMES)


def _names(planes: bytes, n: int) -> np.ndarray:
    width = len(planes) // n
    full = np.zeros((n, 8), np.uint8)
    full[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return full.view(">u8").ravel().astype(np.uint64)


def tied(table: pa.Table, across: bool = False) -> pa.Table:
    """Of one bucket's entries those whose name another entry has (``across``: one of another text), by piece."""
    rows = table.select(["piece", "texts", "places", "names"]).to_pylist()
    sizes = [len(r["texts"]) // 2 if r["names"] else 0 for r in rows]
    names = np.concatenate([np.empty(0, np.uint64), *(_names(r["names"], n) for r, n in zip(rows, sizes) if n)])
    order = np.argsort(names, kind="stable")
    ordered = names[order]
    same = ordered[1:] == ordered[:-1]
    repeated = np.zeros(len(names), bool)
    if len(names) and across:
        # Equal names lie in the order of texts.
        owners = np.concatenate([k << 16 | np.frombuffer(r["texts"], "<u2").astype(np.int64)
                                 for k, (r, n) in enumerate(zip(rows, sizes)) if n])[order]
        edges = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
        repeated[order] = np.repeat(owners[edges[:-1]] != owners[edges[1:] - 1], np.diff(edges))
    elif len(names):
        repeated[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    out: list[tuple] = []
    at = 0
    for r, n in zip(rows, sizes):
        if not n:
            out.append((r["piece"], r["texts"], r["places"]))
            continue
        keep = repeated[at : at + n]
        at += n
        if keep.any():
            out.append((r["piece"], np.frombuffer(r["texts"], "<u2")[keep].tobytes(),
                        np.frombuffer(r["places"], "<u4")[keep].tobytes()))
    columns = list(zip(*out)) or [[], [], []]
    give_back()
    return pa.table({"piece": pa.array(columns[0], pa.int64()), "texts": pa.array(columns[1], pa.binary()),
                     "places": pa.array(columns[2], pa.binary())})


def ties(entries: DataFrame, across: bool = False) -> DataFrame:
    """``(piece, texts, places)`` of all tied entries."""
    def run(table: pa.Table) -> pa.Table:
        return tied(table, across)

    return entries.groupBy("bucket").applyInArrow(run, "piece bigint, texts binary, places binary")


def by_text(found: DataFrame) -> DataFrame:
    """``(no, places)``: the sorted places of every text, packed."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        texts = np.concatenate([np.frombuffer(r["texts"], "<u2") for r in rows]).astype(np.int64)
        places = np.concatenate([np.frombuffer(r["places"], "<u4") for r in rows]).astype(np.int64)
        both = np.unique((texts << 32) | places)
        texts, places = both >> 32, both & 0xFFFFFFFF
        edges = [0, *(np.flatnonzero(np.diff(texts)) + 1).tolist(), len(texts)]
        piece = rows[0]["piece"]
        return pa.table({
            "no": pa.array([piece + int(texts[a]) for a in edges[:-1]], pa.int64()),
            "places": pa.array([places[a:b].astype("<u4").tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
        })

    return found.groupBy("piece").applyInArrow(run, "no bigint, places binary")


def sample_entries(texts: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """Named cover samples of all texts, packed; a place is a position."""
    period, members = difference_cover(length)
    width = length - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1):
            data, offsets = binary_buffers(batch.column(1))
            where = [cover_samples(int(n), width, period, members) for n in np.diff(offsets)]
            counts = np.array([len(w) for w in where])
            if not counts.sum():
                continue
            owner = np.repeat(np.arange(len(where)), counts)
            places = np.concatenate(where)
            names = fingerprints(data, offsets[owner] + places, width, SAMPLE_BASE)
            buckets = ((names >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
            numbers = batch.column(0).to_numpy()
            yield packed_rows(int(numbers[0]), numbers[owner] - numbers[0], places, names, buckets, n_buckets, 6)

    return texts.select("no", "text").mapInArrow(run, PACKED)


def open_suffixes(n: int, marks: np.ndarray, length: int, period: int) -> np.ndarray:
    """Starts that have a tied sample within reach."""
    change = np.zeros(n - length + 2, np.int32)
    np.add.at(change, np.maximum(marks - period + 1, 0), 1)
    np.add.at(change, np.minimum(marks + 1, n - length + 1), -1)
    return np.flatnonzero(np.cumsum(change[:-1]) > 0)


def suffix_entries(open_texts: DataFrame, length: int, n_buckets: int, block: int, n_blocks: int) -> DataFrame:
    """Named suffixes of one block, packed; ``open_texts`` is ``(no, text, marks)``."""
    period, _ = difference_cover(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1, OPEN_BYTES):
            give_back()
            data, offsets = binary_buffers(batch.column(1))
            where = [open_suffixes(int(n), np.frombuffer(m, "<u4").astype(np.int64), length, period)
                     for n, m in zip(np.diff(offsets), batch.column(2).to_pylist())]
            counts = np.array([len(w) for w in where])
            owner = np.repeat(np.arange(len(where)), counts)
            places = np.concatenate(where)
            starts = offsets[owner] + places
            spread = fingerprints(data, starts, length, BUCKET_BASE)
            mine = np.flatnonzero(spread % np.uint64(n_blocks) == block)
            if not len(mine):
                continue
            buckets = ((spread[mine] >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
            names = fingerprints(data, starts[mine], length, SUFFIX_BASE)
            numbers = batch.column(0).to_numpy()
            yield packed_rows(int(numbers[0]), numbers[owner[mine]] - numbers[0], places[mine], names, buckets, n_buckets, 8)

    return open_texts.select("no", "text", "marks").mapInArrow(run, PACKED)


def repeated_spans(starts: np.ndarray, length: int) -> list[dict]:
    """Maximal runs covered by strings at sorted starts."""
    if not len(starts):
        return []
    gaps = np.flatnonzero(np.diff(starts) > length)
    first = starts[np.concatenate([[0], gaps + 1])]
    last = starts[np.concatenate([gaps, [len(starts) - 1]])] + length
    return [{"start": int(a), "end": int(b)} for a, b in zip(first, last)]


SPANS = "array<struct<start:bigint,end:bigint>>"


def _spans_by_text(blocks: DataFrame, length: int) -> DataFrame:
    """``(no, spans)`` from the starts that the blocks have found."""
    def run(table: pa.Table) -> pa.Table:
        starts = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in table.column("places").to_pylist()]).astype(np.int64))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"no": table.column("no")[:1], "spans": pa.array([repeated_spans(starts, length)], kind)})

    return blocks.groupBy("no").applyInArrow(run, f"no bigint, spans {SPANS}")


def distinct_texts(docs: DataFrame, text: str, length: int) -> Stage:
    """``(no, digest, text, n_rows)``: each long enough text once with the number of its rows, numbered, written once."""
    content = whole_text(text).cast("binary")
    long = docs.select(text_digest(content).alias("digest"), content.alias("text")).filter(F.octet_length("text") >= length)
    once = long.groupBy("digest").agg(F.first("text").alias("text"), F.count("*").alias("n_rows"))
    return Stage(once.select(F.monotonically_increasing_id().alias("no"), "digest", "text", "n_rows"), "repeat-texts")


def sliding(pick: np.ufunc, row: np.ndarray, size: int) -> np.ndarray:
    """``pick`` (the minimum or maximum) of every ``size`` neighbours, by the first of them."""
    span = 1
    while 2 * span <= size:
        row = pick(row[:-span], row[span:])
        span *= 2
    return pick(row[: len(row) - size + span], row[size - span :]) if span < size else row


def word_windows(words: Words, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that begin ``n_words`` words of one text, and the 64-bit names of these windows."""
    n = len(words.text)
    at = np.flatnonzero(words.text[: max(n - n_words + 1, 0)] == words.text[n_words - 1 :])
    up, down = _powers(PASSAGE_BASE, 1 << max(n, 1).bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words.hashes * up[:n], out=sums[1:])
    names = (sums[at + n_words] - sums[at]) * down[at]
    names ^= names >> np.uint64(31)
    names *= np.uint64(0xBF58476D1CE4E5B9)
    names ^= names >> np.uint64(30)
    return at, names


def passage_samples(words: Words, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The short windows, of three in ten of the words, that have the least name in a window of ``n_words``: equal
    windows have equal ones."""
    at, _ = word_windows(words, n_words)
    if not len(at):
        return at, np.empty(0, np.uint64)
    width = _sample_words(n_words)
    short, short_names = word_windows(words, width)
    names = np.full(len(words.text), ~np.uint64(0))
    names[short] = short_names
    reach = n_words - width + 1
    least = np.zeros(len(names) + reach - 1, np.uint64)
    least[at + reach - 1] = sliding(np.minimum, names, reach)[at]
    chosen = np.flatnonzero(sliding(np.maximum, least, reach) == names)
    return chosen, names[chosen]


def _sample_words(n_words: int) -> int:
    return max(n_words * 3 // 10, 1)


def open_windows(words: Words, n_words: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`word_windows`, those that hold one of the short windows which begin with the words ``marks``."""
    at, names = word_windows(words, n_words)
    n, reach = len(words.text), n_words - _sample_words(n_words) + 1
    change = np.bincount(np.maximum(marks - reach + 1, 0), minlength=n + 1) - np.bincount(marks + 1, minlength=n + 1)
    held = np.cumsum(change)[at] > 0
    return at[held], names[held]


def passage_entries(texts: DataFrame, n_words: int, n_buckets: int) -> DataFrame:
    """Named samples of all texts, or with ``marks`` their open windows, packed; a place is a word. What two texts of a
    piece hold, and what a text of several rows holds, is settled there."""
    marked = "marks" in texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1, PASSAGE_BYTES):
            give_back()
            data, offsets = binary_buffers(batch.column(1))
            words = words_of(data, offsets, LETTER)
            begins = np.searchsorted(words.text, np.arange(batch.num_rows))
            if marked:
                marks = [np.frombuffer(m, "<u4") + begin for m, begin in zip(batch.column(3).to_pylist(), begins)]
                at, names = open_windows(words, n_words, np.concatenate(marks))
            else:
                at, names = passage_samples(words, n_words)
            if not len(names):
                continue
            texts = words.text[at]
            places = at - begins[texts]
            numbers = batch.column(0).to_numpy()
            order = np.argsort(names, kind="stable")
            texts, places, names = texts[order], places[order], names[order]
            copied = batch.column(2).to_numpy()[texts] > 1
            # Equal names lie in the order of texts.
            edges = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]]))
            first, last = edges[:-1], edges[1:] - 1
            common = texts[first] != texts[last]
            within = np.repeat(common, np.diff(edges))
            texts, piece = numbers[texts] - numbers[0], int(numbers[0])
            rows, settled = [], within | copied
            if settled.any():
                rows.append(_row(piece % n_buckets, piece, texts[settled], places[settled], names[:0], 8))
            # A name that two texts hold is sent for both, so that a single one elsewhere meets it.
            sent = np.sort(np.concatenate([np.flatnonzero(~within), first[common], last[common]]))
            texts, places, names = texts[sent], places[sent], names[sent]
            buckets = ((names >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            rows += [_row(int(buckets[a]), piece, texts[a:b], places[a:b], names[a:b], 8) for a, b in zip(cuts, cuts[1:])]
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=NAMES)
        # A task's Python process stays for the stages that follow.
        _powers.cache_clear()
        words_of_powers.cache_clear()
        give_back()

    return texts.select("no", "text", "n_rows", *["marks"] * marked).mapInArrow(run, PACKED)


def shared_words(texts: DataFrame, partitions: int, n_words: int) -> DataFrame:
    """``(no, n_shared_words)`` of the texts that share a passage with another row: the words that lie in one.

    ``texts`` is ``(no, text, n_rows)`` of distinct texts. Samples that no other row has open no window.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column(1).to_pylist()]
            covered = [int(np.minimum(np.diff(x), n_words).sum()) + n_words for x in starts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(covered, pa.int64())], names=["no", "n_shared_words"])

    def buckets(n_entries: int) -> int:
        return max(partitions, n_entries // BUCKET_ROWS + 1)

    reach = n_words - _sample_words(n_words) + 1
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # On average two samples lie in the reach of a window; a tied one opens no more windows than that.
    samples = passage_entries(texts, n_words, buckets(n_bytes // WORD_BYTES * 2 // (reach + 1)))
    marks = Stage(by_text(ties(samples, across=True)).withColumnRenamed("places", "marks"), "repeat-passages").read()
    n_open = (marks.agg(F.sum(F.octet_length("marks"))).first()[0] or 0) // 4 * reach
    opened = texts.join(marks, "no")
    # Texts that were numbered together come together again, so that pieces are large.
    opened = opened.repartition(partitions, F.shiftright("no", NUMBER_BITS)).sortWithinPartitions("no")
    found = ties(passage_entries(opened, n_words, buckets(n_open)), across=True)
    return by_text(found).mapInArrow(counted, "no bigint, n_shared_words bigint")


def find_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, stage: Stage | None = None) -> DataFrame:
    """``(digest, text, spans)`` of the distinct texts that share a string with another place, text as bytes.

    Positions are bytes. Equal texts count once here; see :func:`removals`. A ``stage`` of the distinct texts may hold
    shorter ones; it is dropped.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    period, members = difference_cover(length)
    stage = stage or distinct_texts(docs, text, length)
    texts = stage.read().select("no", "digest", "text").filter(F.octet_length("text") >= length)
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    with shuffle_cleanup(spark):
        n_buckets = max(partitions, n_bytes * len(members) // period // BUCKET_ROWS + 1)
        marks = Stage(by_text(ties(sample_entries(texts, length, n_buckets))), "repeat-marks")
        marked = marks.read().withColumnRenamed("places", "marks")
        # Texts that were numbered together come together again, so that pieces are large.
        block = F.shiftright("no", NUMBER_BITS)
        opened = Stage(texts.join(marked, "no").repartition(partitions, block).sortWithinPartitions("no"), "repeat-open")
        stage.drop()
        # A mark opens at most one period of suffixes, and a text no more than its bytes.
        most = opened.read().agg(F.sum(F.least(F.octet_length("text"), F.octet_length("marks") / 4 * period))).first()[0] or 0
        n_blocks = int(most // BLOCK_SUFFIXES) + 1
        n_buckets = max(partitions, int(most / n_blocks) // BUCKET_ROWS + 1)
        found = [Stage(by_text(ties(suffix_entries(opened.read(), length, n_buckets, k, n_blocks))), "repeat-starts")
                 for k in range(n_blocks)]
        starts = found[0].read()
        for block in found[1:]:
            starts = starts.unionByName(block.read())
        spans = Stage(_spans_by_text(starts, length), "repeat-spans")
        for block in found:
            block.drop()
    return opened.read().join(spans.read(), "no").select("digest", "text", "spans")


def removals(
    docs: DataFrame, text: str = "text", length: int = LENGTH, row: str = "row", passage_words: int = 0,
) -> DataFrame:
    """``(row, n_bytes, n_removed, n_spans, kept_sha256)`` for every input row; ``row`` is the row without its text.

    With ``passage_words``, ``n_shared_words`` follows: the words in passages of so many that another row has as well.
    """
    content = whole_text(text).cast("binary")
    rows = docs.select(
        F.struct(*[F.col(c) for c in docs.columns if c != text]).alias(row), text_digest(content).alias("digest"),
        F.octet_length(content).cast("long").alias("n_bytes"), F.sha2(content, 256).alias("whole_sha256"))
    stage = words = None
    if passage_words:
        # So many words have a byte each and a gap between them at least.
        stage = distinct_texts(docs, text, min(length, 2 * passage_words - 1))
        partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        with shuffle_cleanup(docs.sparkSession):
            shared = shared_words(stage.read(), partitions, passage_words)
            words = Stage(stage.read().select("no", "digest").join(shared, "no").drop("no"), "repeat-words")
    found = find_repeats(docs, text, length, stage)
    parts = kept_facts(found)
    copies = rows.filter(F.col("n_bytes") >= length).groupBy("digest").count().filter("count > 1").select(
        "digest", F.lit(True).alias("copied"))
    facts = parts.join(copies, "digest", "full").select(
        "digest", "copied", "n_removed", "n_spans", "kept_sha256")
    if words:
        facts = facts.join(words.read(), "digest", "full")
    joined = rows.join(facts, "digest", "left")
    whole = F.coalesce("copied", F.lit(False))
    return joined.select(
        row, "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        *([F.coalesce("n_shared_words", F.lit(0)).cast("long").alias("n_shared_words")] if words else []),
    )


def kept_bytes(content: bytes, spans: list[dict]) -> bytes:
    parts, at = [], 0
    for span in spans:
        parts.append(content[at : span["start"]])
        at = span["end"]
    return b"".join(parts) + content[at:]


def kept_facts(found: DataFrame) -> DataFrame:
    """``(digest, n_removed, n_spans, kept_sha256)`` of texts with spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [kept_bytes(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), batch.column(2)],
                                             names=["digest", "kept", "spans"])

    kept = found.mapInArrow(run, f"digest binary, kept binary, spans {SPANS}")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return kept.select("digest", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))
