"""BPE encoding by a pair occurrence index, and decoding.

Every task keeps one index over the distinct word forms it meets: each adjacent pair of symbols points to all its
places. The lowest active rank is taken, merged at all its places, and only the lists of the touched neighbours
change. Texts are then joined from the coded forms, so the work per repeated form is one look-up.

Defined results: a missing text counts as an empty one and has no ids; very long texts are coded whole; each row is
coded for itself, so repeated rows and ids are harmless; other columns are carried along unread. A vocabulary in
which a merge makes a pair of lower rank than its own is refused, because then one ascending pass is not enough.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from panelwright.llm.common import give_back, row_pieces

# Word forms a task remembers before it starts anew, and bytes of text it codes at once; bounds on memory only.
REMEMBERED_FORMS = 100_000
PIECE_BYTES = 1 << 20
# Forms of these letters are the same in NFC, have lower case by the letter, and hold no white space.
LATIN = re.compile("[\x21-\x7e\xa1-\u024f]+")
# Byte-level vocabularies spell a byte by its own Latin-1 letter if that can be printed, else by one from 256 on.
PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = dict(zip(sorted(set(range(256)) - PRINTED), map(chr, range(256, 512))))


class Vocabulary:
    """The tables of a BPE file and its text rules."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            tables = json.load(file)
        model = tables["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in tables.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        size = max([*self.ids.values(), *self.added.values()]) + 1
        self.tokens = [""] * size
        for token, place in {**self.ids, **self.added}.items():
            self.tokens[place] = token
        self.size = size
        rows = []
        made: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            token = self.ids[left + right]
            rows.append((self.ids[left] * size + self.ids[right], rank, token))
            made.setdefault(token, rank)
        if any(made.get(part, -1) >= rank for key, rank, _ in rows for part in divmod(key, size)):
            raise ValueError("a merge of this vocabulary makes a pair of lower rank")
        table = np.array(rows, dtype=np.int64).reshape(-1, 3)
        self.merge_pair, self.merge_token = table[:, 0].copy(), table[:, 2].copy()
        table = table[np.argsort(table[:, 0])]
        self.pair_keys, self.pair_ranks = table[:, 0].copy(), table[:, 1].copy()
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.plain = self._plain_rule(tables)
        self.lines = regex.compile(self.plain.pattern + "|\n") if self.plain else None
        self.letter_ids, self.last_ids = np.full(512, -1, np.int32), np.full(512, -1, np.int32)
        for letter in (chr(k) for k in range(512)):
            self.letter_ids[ord(letter)] = self.ids.get(letter, -1)
            self.last_ids[ord(letter)] = self.ids.get(letter + self.suffix, -1)
        self.known: dict[str, bytes] = {"": b""}

    @staticmethod
    def _plain_rule(tables: dict) -> regex.Pattern | None:
        """The file's splitting pattern, if printable ASCII needs only lower case and that pattern."""
        steps = [n.get("type") for n in (tables.get("normalizer") or {}).get("normalizers", [])]
        split = (tables.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in split] == ["Split", "ByteLevel"]:
            if split[0].get("invert") and split[0].get("behavior") == "Removed" and not split[1].get("use_regex"):
                return regex.compile(split[0]["pattern"]["Regex"])
        return None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def pieces(self, form: str) -> list[int | str]:
        """Ids of added tokens and the word pieces between them, in order."""
        found: list[int | str] = []
        for part in self.cut.split(form) if self.cut and "<" in form else [form]:
            if part in self.added:
                found.append(self.added[part])
            elif part and self.plain is not None and part.isascii() and part.isprintable():
                found += self.plain.findall(part.lower())
            elif part:
                clean = self.normalizer.normalize_str(part) if self.normalizer else part
                found += [piece for piece, _ in self.pre_tokenizer.pre_tokenize_str(clean)]
        return found

    def split(self, forms: Sequence[str]) -> list[list[int | str]]:
        """The pieces of every form; forms of plain letters are lowered and split all at once."""
        found: list[list[int | str]] = [[]] * len(forms)
        quick = [k for k, f in enumerate(forms) if self.plain and LATIN.fullmatch(f) and not (self.cut and "<" in f)]
        parts: list[int | str] = []
        at = iter(quick)
        for piece in self.lines.findall("\n".join([forms[k] for k in quick]).lower() + "\n") if quick else ():
            if piece == "\n":
                found[next(at)] = parts
                parts = []
            else:
                parts.append(piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LETTERS))
        for k in sorted(set(range(len(forms))) - set(quick)):
            found[k] = self.pieces(forms[k])
        return found

    def learn(self, forms: Sequence[str]) -> dict[str, bytes]:
        """Packed ids of word forms, all found through one pair occurrence index."""
        split = self.split(forms)
        words: dict[str, int] = {}
        for parts in split:
            for part in parts:
                if type(part) is str:
                    words.setdefault(part, len(words))
        ids, ends = merged(self, list(words))
        packed = ids.astype("<u4").tobytes()
        ends = (4 * ends).tolist()
        coded = dict(zip(words, [packed[a:b] for a, b in zip([0, *ends], ends)]))
        return {
            form: coded[parts[0]] if len(parts) == 1 and type(parts[0]) is str
            else b"".join([coded[p] if type(p) is str else p.to_bytes(4, "little") for p in parts])
            for form, parts in zip(forms, split)
        }

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        places: dict[str, int] = {}
        rows = []
        for text in texts:
            rows.append(np.array([places.setdefault(f, len(places)) for f in text.replace("\n", " ").split(" ")], np.int32))
        known = self.known
        coded = self.learn([form for form in places if form not in known])
        codes = [known[form] if form in known else coded[form] for form in places]
        if len(known) + len(coded) > REMEMBERED_FORMS:
            known = self.known = {"": b""}
        if len(coded) <= REMEMBERED_FORMS:
            known.update(coded)
        return [b"".join([codes[k] for k in row.tolist()]) for row in rows]

    def decode(self, ids: bytes) -> str:
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def merged(vocabulary: Vocabulary, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Joined ids of all words and where each word ends, by one pair occurrence index over all of them.

    ``places[rank]`` lists where the pair of that rank may stand. The lowest active rank is merged at all its places;
    the new neighbours' pairs are added to their lists. A listed place whose pair has changed meanwhile is passed over.
    """
    if not words:
        return np.empty(0, np.int64), np.zeros(0, np.int64)
    # Pieces are spelled in the 256 letters that stand for bytes.
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum([len(word) for word in words])
    symbols = vocabulary.letter_ids[letters]
    symbols[ends - 1] = vocabulary.last_ids[letters[ends - 1]]
    if (symbols < 0).any():  # the library leaves unknown symbols out
        ends = np.cumsum(symbols >= 0)[ends - 1]
        symbols = symbols[symbols >= 0]
    sizes = np.diff(ends, prepend=0)
    n = len(symbols)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    last = ends[sizes > 0] - 1
    after[last] = -1
    before[last[:-1] + 1] = -1
    open_places = np.flatnonzero(after >= 0)
    places: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def listed(where: np.ndarray, ranks: np.ndarray) -> None:
        hit = ranks >= 0
        if not hit.any():
            return
        where, ranks = where[hit], ranks[hit]
        order = np.argsort(ranks, kind="stable")
        where, ranks = where[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        edges = [0, *cuts.tolist(), len(ranks)]
        for start, end, rank in zip(edges, edges[1:], ranks[[0, *cuts.tolist()]].tolist()):
            if rank in places:
                places[rank].append(where[start:end])
            else:
                places[rank] = [where[start:end]]
                heapq.heappush(active, rank)

    listed(open_places, vocabulary.ranks(symbols[open_places], symbols[after[open_places]]))
    while active:
        rank = heapq.heappop(active)
        lists = places.pop(rank)
        left, right = divmod(int(vocabulary.merge_pair[rank]), vocabulary.size)
        token = int(vocabulary.merge_token[rank])
        here = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        here = here[symbols[here] == left]
        mate = after[here]
        fits = mate >= 0
        fits[fits] = symbols[mate[fits]] == right
        here, mate = here[fits], mate[fits]
        if left == right and len(here) > 1:  # of overlapping places the left one counts
            taken, chosen = set(), []
            for k, (a, b) in enumerate(zip(here.tolist(), mate.tolist())):
                if a not in taken:
                    taken.add(b)
                    chosen.append(k)
            here, mate = here[chosen], mate[chosen]
        if not len(here):
            continue
        ahead = after[mate]
        symbols[here], symbols[mate] = token, -1
        after[here] = ahead
        inner = ahead >= 0
        before[ahead[inner]] = here[inner]
        behind = before[here]
        behind = behind[behind >= 0]
        starts = np.concatenate([here[inner], behind])
        if len(starts):
            listed(starts, vocabulary.ranks(symbols[starts], symbols[after[starts]]))
    alive = symbols >= 0
    return symbols[alive], np.concatenate([[0], np.cumsum(alive)])[ends]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    found = Vocabulary(path)
    give_back()  # reading the file takes twice the room of what is kept
    return found


def _mapped(df: DataFrame, source: str, targets: dict[str, tuple[T.DataType, pa.DataType]], change) -> DataFrame:
    """The rows with new columns made of one column, piece by piece; a column of a new one's name gives way."""
    kept = [c for c in df.columns if c not in targets]
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields,
                           *[T.StructField(name, kind) for name, (kind, _) in targets.items()]])
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(source).alias("__source"))
    arrow = [kind for _, kind in targets.values()]

    def changed(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = change(batch.column(len(kept)).to_pylist())
        columns = [*batch.columns[:-1], *(pa.array(x, kind) for x, kind in zip(made, arrow))]
        return pa.RecordBatch.from_arrays(columns, names=[*kept, *targets])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # No batch is held here any more when memory is given back.
        yield from map(changed, row_pieces(batches, len(kept), PIECE_BYTES))
        give_back()

    return rows.mapInArrow(run, schema)


BINARY, TEXT = (T.BinaryType(), pa.binary()), (T.StringType(), pa.string())


def _encoded(path: str, texts: list) -> list[bytes]:
    return vocabulary(path).encode(["" if x is None else x for x in texts])


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with their ids, packed as little-endian unsigned 32-bit integers."""
    return _mapped(docs, text, {ids: BINARY}, lambda texts: [_encoded(path, texts)])


def decode(coded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The rows with the text of their packed ids: the tokens, joined by blanks; missing ids count as none."""
    return _mapped(coded, ids, {decoded: TEXT}, lambda rows: [[vocabulary(path).decode(x or b"") for x in rows]])


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass, so that one set of tables per task is enough."""
    def change(texts: list) -> list:
        coded = _encoded(path, texts)
        return [coded, [vocabulary(path).decode(x) for x in coded]]

    return _mapped(docs, text, {ids: BINARY, decoded: TEXT}, change)
