"""SentencePiece encoding by a table of distinct chunks, and decoding.

No piece of the models served here holds a white-space marker behind another character, so no merge crosses the place
before a run of markers. Every task cuts a block of texts there, keeps each distinct chunk once, segments only these, and
joins their ids back to the texts by position. Distinct chunks of one length are segmented side by side: each round merges
the best pair of every chunk.

Defined results: a missing text counts as an empty one, which has the begin and end ids only; very long texts and chunks are
coded whole (a chunk above ``SIDE_BY_SIDE`` characters by a heap of its pairs); each row is coded for itself, so repeated rows
and ids are harmless, and an empty table gives an empty one; other columns are carried along unread, but for columns that
have the name of a new one, which are replaced. Decoding takes an id that the model lacks for the unknown one, missing ids for
none, and gives U+FFFD for each byte that is not UTF-8. A model of other rules (another normaliser, pieces across markers,
own symbols) is refused.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.common import binary_array, binary_buffers, give_back, row_pieces

MARK = "▁"
# What decoding writes for the unknown id.
UNKNOWN_TEXT = " ⁇ "
# Bounds on memory only: bytes of text coded at once, chunks a task remembers, characters of chunks segmented side by side.
BLOCK_BYTES = 4 << 20
REMEMBERED_CHUNKS = 200_000
SIDE_BY_SIDE = 48
# Texts the library and the tables must agree on before a model is used.
PROBES = ("", " ", "  a  b ", "Fine text,\nwith \t lines\r\n", "▁a▁ é ﬁ 　 漢\U0001f600 <s></s><0x0A>", "x" * 99)
NO_PAIR = np.int32(np.iinfo(np.int32).max)


class Pieces:
    """The tables of a model: pieces, the pairs that make them, and the text of every id."""

    def __init__(self, path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        self.begin, self.end, self.unknown = library.bos_id(), library.eos_id(), library.unk_id()
        if min(self.begin, self.end, self.unknown) < 0 or any(library.is_unused(k) for k in range(size)):
            raise ValueError("the model lacks begin, end or unknown id, or has unused pieces")
        self.control = np.array([library.is_control(k) for k in range(size)])
        self.of_byte = np.full(256, self.unknown, np.int64)
        self.ids: dict[str, int] = {}
        texts = []
        for k in range(size):
            piece = library.id_to_piece(k)
            if library.is_byte(k):
                self.of_byte[int(piece[1:-1], 16)] = k
                texts.append(bytes([int(piece[1:-1], 16)]))
            elif self.control[k]:
                texts.append(b"")
            elif k == self.unknown:
                texts.append(UNKNOWN_TEXT.encode())
            else:
                self.ids[piece] = k
                texts.append(piece.replace(MARK, " ").encode())
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("pieces of this model cross white-space markers")
        letters = {c for piece in self.ids for c in piece}
        if not letters <= set(self.ids) or (self.of_byte == self.unknown).any():
            raise ValueError("a letter of the pieces is no piece, or bytes are missing")
        self.walls_lines = "\n" not in letters
        self.high = np.isin(np.arange(size), self.of_byte[128:])
        self.marked = np.array([t[:1] == b" " and k not in (self.unknown, self.of_byte[32]) for k, t in enumerate(texts)])
        self.text_ends = np.cumsum([len(t) for t in texts])
        self.text_bytes = np.frombuffer(b"".join(texts), np.uint8)
        # Rank: place of a piece's score among all, best first; pieces of one score share it.
        scores = np.array([library.get_score(k) for k in self.ids.values()])
        rank = dict(zip(self.ids.values(), np.unique(-scores, return_inverse=True)[1].tolist()))
        self.size = size + 0x110000  # symbols from ``letters_from`` on are characters outside the pieces
        self.letters_from = size
        rows = sorted(
            (self.ids[piece[:cut]] * self.size + self.ids[piece[cut:]], rank[k], k)
            for piece, k in self.ids.items() for cut in range(1, len(piece)) if piece[:cut] in self.ids and piece[cut:] in self.ids)
        table = np.array(rows, np.int64).reshape(-1, 3)
        self.pair_keys = np.concatenate([table[:, 0], [np.iinfo(np.int64).max]])
        self.pair_ranks = np.concatenate([table[:, 1].astype(np.int32), [NO_PAIR]])
        self.pair_pieces = np.concatenate([table[:, 2], [0]])
        self.pairs = {key: (rank_, made) for key, rank_, made in rows}
        low = 0x3000
        self.letter_ids = np.array([self.ids.get(chr(c), size + c) for c in range(low)], np.int64)
        self.known: dict[str, bytes] = {}
        for probe in PROBES:
            if self.encode_one(probe) != library.encode(probe, add_bos=True, add_eos=True):
                raise ValueError("the model's rules are not those of these tables")

    def symbols(self, text: str) -> np.ndarray:
        """The id of each character, or its code point behind the ids."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        low = codes < len(self.letter_ids)
        found = codes + self.letters_from
        found[low] = self.letter_ids[codes[low]]
        for at in np.flatnonzero(~low).tolist():
            found[at] = self.ids.get(chr(codes[at]), found[at])
        return found

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols (``NO_PAIR`` for none) and the piece it makes."""
        keys = left * self.size + right
        at = np.searchsorted(self.pair_keys, keys)
        at = np.where(self.pair_keys[at] == keys, at, len(self.pair_keys) - 1)
        return self.pair_ranks[at], self.pair_pieces[at]

    def side_by_side(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks of one length (rows of symbols), all merged at once; rows that are done, with their symbols."""
        rows = np.arange(len(symbols))
        ranks, made = self.look_up(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            width = symbols.shape[1]
            if width == 1:
                yield rows, symbols
                return
            best = ranks.argmin(axis=1)  # the leftmost of the best
            here = np.arange(len(rows))
            open_ = ranks[here, best] != NO_PAIR
            if not open_.all():
                yield rows[~open_], symbols[~open_]
                rows, symbols, ranks, made, best = rows[open_], symbols[open_], ranks[open_], made[open_], best[open_]
                here = np.arange(len(rows))
                if not len(rows):
                    return
            symbols[here, best] = made[here, best]
            columns = np.arange(width - 1)[None, :]
            symbols = np.take_along_axis(symbols, columns + (columns > best[:, None]), axis=1)
            columns = columns[:, :-1]
            shift = columns + (columns >= best[:, None])
            ranks, made = np.take_along_axis(ranks, shift, axis=1), np.take_along_axis(made, shift, axis=1)
            for side in (best - 1, best):
                has = (side >= 0) & (side < width - 2)
                row, column = here[has], side[has]
                ranks[row, column], made[row, column] = self.look_up(symbols[row, column], symbols[row, column + 1])

    def by_heap(self, symbols: list[int]) -> list[int]:
        """One long chunk: the best pair first, the leftmost of equals, until no pair makes a piece."""
        n = len(symbols)
        after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            found = self.pairs.get(symbols[a] * self.size + symbols[b])
            if found:
                heapq.heappush(heap, (found[0], a, symbols[a], symbols[b], found[1]))

        for a in range(n - 1):
            offer(a, a + 1)
        while heap:
            _, a, left, right, made = heapq.heappop(heap)
            b = after[a]
            if symbols[a] != left or b < 0 or symbols[b] != right:
                continue
            symbols[a], symbols[b] = made, -1
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
                offer(a, after[b])
            if before[a] >= 0:
                offer(before[a], a)
        return [s for s in symbols if s >= 0]

    def packed(self, symbols: Sequence[int]) -> bytes:
        """Ids as little-endian 32-bit integers; a character outside the pieces becomes its bytes."""
        ids: list[int] = []
        for s in symbols:
            if s < self.letters_from:
                ids.append(s)
            else:
                ids += self.of_byte[list(chr(s - self.letters_from).encode())].tolist()
        return np.array(ids, "<u4").tobytes()

    def segment(self, chunks: Sequence[str]) -> dict[str, bytes]:
        """Packed ids of distinct chunks."""
        by_length: dict[int, list[str]] = {}
        coded: dict[str, bytes] = {}
        for chunk in chunks:
            by_length.setdefault(len(chunk), []).append(chunk)
        for length, group in by_length.items():
            if length > SIDE_BY_SIDE:
                for chunk in group:
                    coded[chunk] = self.packed(self.by_heap(self.symbols(chunk).tolist()))
                continue
            for rows, symbols in self.side_by_side(self.symbols("".join(group)).reshape(len(group), length)):
                if symbols.max() < self.letters_from:
                    whole = symbols.astype("<u4").tobytes()
                    step = 4 * symbols.shape[1]
                    for k, row in enumerate(rows.tolist()):
                        coded[group[row]] = whole[k * step : (k + 1) * step]
                else:
                    for row, ids in zip(rows.tolist(), symbols.tolist()):
                        coded[group[row]] = self.packed(ids)
        return coded

    def coded(self, chunks: Sequence[str]) -> list[bytes]:
        """Packed ids of each distinct chunk; chunks met before are remembered."""
        known = self.known
        lines = {c: c.split("\n") for c in chunks if c not in known and "\n" in c} if self.walls_lines else {}
        wanted = dict.fromkeys(c for c in chunks if c not in known and c not in lines)
        for parts in lines.values():
            wanted.update((p, None) for p in parts if p and p not in known)
        fresh = self.segment(list(wanted))
        fresh[""] = b""
        break_ = int(self.of_byte[10]).to_bytes(4, "little")
        for chunk, parts in lines.items():
            fresh[chunk] = break_.join([fresh[p] if p in fresh else known[p] for p in parts])
        found = [fresh[c] if c in fresh else known[c] for c in chunks]
        if len(known) + len(fresh) > REMEMBERED_CHUNKS:
            known = self.known = {}
        if len(fresh) <= REMEMBERED_CHUNKS:
            known.update((c, ids) for c, ids in fresh.items() if len(c) <= SIDE_BY_SIDE)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and the offsets of the texts in them."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if pc.any(pc.match_substring(texts, MARK)).as_py():
            texts = pc.replace_substring(texts, MARK, " ")
        split = pc.split_pattern(texts, " ")
        cuts = split.offsets.to_numpy().astype(np.int64)
        cuts -= cuts[0]
        parts = split.flatten().dictionary_encode()
        parts = parts.combine_chunks() if isinstance(parts, pa.ChunkedArray) else parts
        words = parts.dictionary.to_pylist()
        word = parts.indices.to_numpy().astype(np.int64)
        # A part that is not empty, or the last of its text, ends a chunk: one marker for each part since the chunk before.
        ends = np.array([w != "" for w in words], bool)[word] if words else np.zeros(0, bool)
        has = cuts[1:] > cuts[:-1]
        last = cuts[1:][has] - 1
        ends[last] = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)[has]
        place = np.flatnonzero(ends)
        text = np.searchsorted(cuts, place, side="right") - 1
        marks = place - np.maximum(np.concatenate([[-1], place[:-1]]), cuts[text] - 1)
        keys, chunk = np.unique(marks * len(words) + word[place], return_inverse=True)
        coded = self.coded([MARK * (k // len(words)) + words[k % len(words)] for k in keys.tolist()])
        sizes = np.array([len(ids) // 4 for ids in coded], np.int64)
        table = np.frombuffer(b"".join(coded), "<u4")
        starts = np.cumsum(sizes) - sizes
        amount = sizes[chunk]
        so_far = np.cumsum(amount)
        per_text = np.bincount(text, weights=amount, minlength=len(texts)).astype(np.int64) + 2
        offsets = np.concatenate([[0], np.cumsum(per_text)])
        joined = np.empty(offsets[-1], np.uint32)
        joined[offsets[:-1]], joined[offsets[1:] - 1] = self.begin, self.end
        inner = np.repeat(starts[chunk] - (so_far - amount), amount) + np.arange(so_far[-1] if len(so_far) else 0)
        middle = np.ones(len(joined), bool)
        middle[offsets[:-1]] = middle[offsets[1:] - 1] = False
        joined[middle] = table[inner]
        return joined, offsets

    def encode_one(self, text: str) -> list[int]:
        return self.encode(pa.array([text]))[0].tolist()

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The text of every row of joined ids."""
        ids = np.where(ids < len(self.control), ids, self.unknown).astype(np.int64)
        ends = self.text_ends[ids]
        begins = np.where(ids > 0, self.text_ends[ids - 1], 0)
        # The first id that writes something loses its marker.
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        writes = np.flatnonzero(~self.control[ids])
        first = writes[np.concatenate([[True], row[writes][1:] != row[writes][:-1]])] if len(writes) else writes
        begins[first] += self.marked[ids[first]]
        amount = ends - begins
        so_far = np.concatenate([[0], np.cumsum(amount)])
        joined = self.text_bytes[np.repeat(begins - so_far[:-1], amount) + np.arange(so_far[-1])]
        made = binary_array(joined, so_far[offsets])
        # Bytes on both sides of a control id never make one character.
        walls = np.flatnonzero(self.control[ids[1:-1]] & self.high[ids[:-2]] & (self.high | self.control)[ids[2:]]) + 1
        walled = set(row[walls].tolist())
        try:
            if not walled:
                return made.cast(pa.string())
        except pa.ArrowInvalid:
            pass
        texts = [repaired(b) for b in made.to_pylist()]
        for k in walled:
            a, b = offsets[k], offsets[k + 1]
            cuts = [a, *(np.flatnonzero(self.control[ids[a:b]]) + a).tolist(), b]
            texts[k] = "".join(repaired(joined[so_far[x] : so_far[y]].tobytes()) for x, y in pairwise(cuts))
        return pa.array(texts, pa.string())


def repaired(text: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that is part of no character."""
    found = []
    while True:
        try:
            found.append(text.decode())
            return "".join(found)
        except UnicodeDecodeError as error:
            found.append(text[: error.start].decode() + "�")
            text = text[error.start + 1 :]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _mapped(df: DataFrame, source: str, targets: dict[str, T.DataType], change) -> DataFrame:
    """The rows with new columns made of one column, block by block."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in targets]
    schema = T.StructType([*df.select(*kept).schema.fields, *[T.StructField(n, kind) for n, kind in targets.items()]])
    rows = df.select(*kept, F.col(f"`{source}`").alias("__source"))
    names, last = schema.names, len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_pieces(batches, last, BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *change(batch.column(last))], names=names)
        give_back()

    return rows.mapInArrow(run, schema)


def _ids_array(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return binary_array(np.frombuffer(ids.astype("<u4").tobytes(), np.uint8), 4 * offsets)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with their ids, begin and end included, packed as little-endian unsigned 32-bit integers."""
    return _mapped(docs, text, {ids: T.BinaryType()}, lambda texts: [_ids_array(*pieces(path).encode(texts))])


def decode(coded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The rows with the text of their packed ids."""
    def change(rows: pa.Array) -> list[pa.Array]:
        joined, offsets = binary_buffers(pc.fill_null(rows, b""))
        return [pieces(path).decode(np.frombuffer(joined.tobytes(), "<u4"), offsets // 4)]

    return _mapped(coded, ids, {decoded: T.StringType()}, change)


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """:func:`encode`, then :func:`decode` of its ids, in one pass over the texts."""
    def change(texts: pa.Array) -> list[pa.Array]:
        joined, offsets = pieces(path).encode(texts)
        return [_ids_array(joined, offsets), pieces(path).decode(joined, offsets)]

    return _mapped(docs, text, {ids: T.BinaryType(), decoded: T.StringType()}, change)
