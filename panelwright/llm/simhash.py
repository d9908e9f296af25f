"""SimHash near-duplicates by BK-trees.

Fingerprints are linked when they differ in at most ``radius`` bits. The 64 bits are cut into ``blocks`` blocks; of two
linked fingerprints at least ``blocks - radius`` blocks agree, so each choice of that many blocks is a shard key, and
linked fingerprints meet in a shard. Each shard is a BK-tree over the distinct fingerprints with its key: a child hangs
at its Hamming distance to the parent, and a search follows only edges within the radius. A branch that lies wholly in
the searcher's component has nothing to add and is skipped, so a shard of near copies costs little more than its
members, and sends on at most one link per member, however many pairs it holds. The number of blocks follows from the number of fingerprints and changes the plan, never the
links. Shards with more members than a task should hold are cut into pieces: every piece's tree is searched by all
members, one piece at a time.

Components come from rounds of smallest-label propagation with pointer jumping over the links, written to the shared
folder each round.

Defined results: a missing text counts as an empty one and has fingerprint zero, linked like any other; fewer words
than a shingle form one shingle; equal texts share a fingerprint, so repeated rows and ids cost one row; a component
without ids has none. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import Stage, whole_text

SEED = 42
WORDS = 4
RADIUS = 4
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# Members of a shard that one tree holds, and of an average shard before more blocks are used.
TREE_MEMBERS = 20_000
SHARD_MEMBERS = 64


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every shingle of lower-case words, repeats included."""
    parts = WORD.findall(text.translate(LOWER))
    if not parts:
        return np.empty(0, "<u8")
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    last = ends[-n:] if len(parts) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())], dtype="<u8")


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Bits that are set in more than half of the shingles' hashes."""
    hashes = shingle_hashes(text, words)
    bits = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 15):
        part = hashes[start : start + (1 << 15)].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * bits > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, text: str = "text", row: str = "row", words: int = WORDS) -> DataFrame:
    """``(row, fp)``: the input row without its text, and the fingerprint as a signed 64-bit number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, int] = {}
            column = batch.column(1).to_pylist()
            for content in column:
                if content not in seen:
                    seen[content] = fingerprint(content, words)
            values = np.array([seen[x] for x in column], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=[row, "fp"])

    rows = docs.select(
        F.struct(*[F.col(c) for c in docs.columns if c != text]).alias(row), whole_text(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, rows.select(row).withColumn("fp", F.lit(0).cast("long")).schema)


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """As many blocks as keep an average shard small; each further block lengthens the key."""
    blocks = radius + 1
    while blocks < radius + 4 and n / 2 ** (64 // blocks * (blocks - radius)) > SHARD_MEMBERS:
        blocks += 1
    return blocks


def _shard_keys(blocks: int, radius: int) -> Column:
    """One key per choice of blocks: the choice's number and the chosen bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for place, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(place).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


class Tree:
    """A BK-tree: node k has a fingerprint and children by distance, and knows if its branch is one component."""

    def __init__(self, radius: int):
        self.radius = radius
        self.nodes: list[int] = []
        self.children: list[dict[int, int]] = []
        self.whole: list[int | None] = []  # a member, if all of the branch are in its component
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def link(self, value: int) -> list[int]:
        """Join the value to every component within the radius and name one partner of each.

        Only edges whose distance fits are followed, and no branch that lies in the value's component already.
        """
        if not self.nodes:
            return []
        partners, waiting = [], [0]
        nodes, children, whole, radius, find = self.nodes, self.children, self.whole, self.radius, self.find
        while waiting:
            here = waiting.pop()
            if whole[here] is not None and find(whole[here]) == find(value):
                continue
            distance = (nodes[here] ^ value).bit_count()
            if distance <= radius:
                mine, other = find(value), find(nodes[here])
                if mine != other:
                    self.root[max(mine, other)] = min(mine, other)
                    partners.append(nodes[here])
            edges = children[here]
            if edges:
                low, high = distance - radius, distance + radius
                waiting += [node for edge, node in edges.items() if low <= edge <= high]
        return partners

    def add(self, value: int) -> None:
        nodes, children, whole = self.nodes, self.children, self.whole
        here, mine = 0, self.find(value)
        while nodes:
            if whole[here] is not None and self.find(whole[here]) != mine:
                whole[here] = None
            distance = (nodes[here] ^ value).bit_count()
            following = children[here].get(distance)
            if following is None:
                children[here][distance] = len(nodes)
                break
            here = following
        nodes.append(value)
        children.append({})
        whole.append(value)


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that span the components of all pairs within the radius."""
    tree, found = Tree(radius), []
    for value in values:
        found += [(value, partner) for partner in tree.link(value)]
        tree.add(value)
    return found


def piece_links(members: list[int], probes: list[int], radius: int) -> list[tuple[int, int]]:
    """Links of a piece's members and of the probes to them."""
    tree = Tree(radius)
    found = []
    for value in members:
        found += [(value, partner) for partner in tree.link(value)]
        tree.add(value)
    for value in probes:
        found += [(value, partner) for partner in tree.link(value) if value != partner]
    return found


def links(found: DataFrame, radius: int = RADIUS, blocks: int | None = None, members: int = TREE_MEMBERS) -> DataFrame:
    """``(a, b)``: links whose components are those of all pairs of distinct ``fp`` within the radius."""
    n_blocks = blocks or blocks_for(found.count(), radius)
    keyed = found.select("fp", F.explode(_shard_keys(n_blocks, radius)).alias("key"))
    sizes = keyed.groupBy("key").count().filter("count > 1")
    crowded = Stage(keyed.join(sizes, "key").select("fp", "key", F.ceil(F.col("count") / members).cast("int").alias("pieces")),
                    "simhash-shards")
    # A probe meets every piece of its shard; a member of the tree belongs to one piece. A shard of one piece needs
    # no probes of its own: its members are both.
    piece = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    trees = crowded.read().select("key", piece.alias("piece"), "fp", "pieces")
    small, big = trees.filter("pieces = 1"), trees.filter("pieces > 1").drop("pieces")
    probes = crowded.read().filter("pieces > 1").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "fp")

    def near_pieces(pdf_key, left: pa.Table, right: pa.Table) -> pa.Table:
        tree = sorted(v & 0xFFFFFFFFFFFFFFFF for v in left.column("fp").to_pylist())
        asked = [v & 0xFFFFFFFFFFFFFFFF for v in right.column("fp").to_pylist()]
        return _link_table(piece_links(tree, asked, radius))

    # Many small shards share a task: they are sorted by key and cut where the key changes.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []
        out: list[tuple[int, int]] = []
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for key, value in zip(keys, batch.column(2).to_pylist()):
                if key != held_key:
                    if len(held) > 1:
                        out += shard_links(held, radius)
                    held_key, held = key, []
                held.append(value & 0xFFFFFFFFFFFFFFFF)
            if len(out) > 50_000:
                yield from _link_table(out).to_batches()
                out = []
        if len(held) > 1:
            out += shard_links(held, radius)
        if out:
            yield from _link_table(out).to_batches()

    tasks = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    in_order = small.select("key.choice", "key.bits", "fp").repartition(tasks, "choice", "bits").sortWithinPartitions(
        "choice", "bits", "fp")
    result = in_order.mapInArrow(run, "a bigint, b bigint")
    if big.limit(1).count():
        result = result.unionByName(
            big.groupBy("key", "piece").cogroup(probes.groupBy("key", "piece")).applyInArrow(near_pieces, "a bigint, b bigint"))
    return result.distinct()


def _link_table(found: list[tuple[int, int]]) -> pa.Table:
    pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.table({"a": pa.array(np.ascontiguousarray(pairs[:, 0])), "b": pa.array(np.ascontiguousarray(pairs[:, 1]))})


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(fp, label)`` of every linked fingerprint: the smallest ``fp`` it can reach.

    Large-star and small-star rounds: each node sends its neighbours the smallest one it knows, so the depth of the
    stars shrinks quickly and no round gathers a component in one place.
    """
    stage = Stage(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    while True:
        # Large star: larger neighbours of a node link to the smallest node around it.
        both = stage.read().union(stage.read().select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").filter("b > a AND b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        step = Stage(large.distinct(), "components")
        # Small star: a node and its smaller neighbours link to the smallest of them.
        rows = step.read()
        low = rows.groupBy("a").agg(F.min("b").alias("low"))
        small = rows.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        following = Stage(small.union(low.select("a", "low")).distinct(), "components")
        before, after = stage.read(), following.read()
        same = before.count() == after.count() and before.join(after, ["a", "b"], "left_anti").limit(1).count() == 0
        step.drop()
        stage.drop()
        stage = following
        if same:
            return stage.read().select(F.col("a").alias("fp"), F.col("b").alias("label"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(row, fp, component_id)``: the smallest id that each row reaches over links."""
    stage = Stage(fingerprints(docs, text), "simhash")
    rows = stage.read()
    ids = Stage(rows.groupBy("fp").agg(F.min(F.col("row").getField(doc_id)).alias("first")), "simhash-ids")
    labels = components(ids.read(), links(ids.read().select("fp"), radius))
    grouped = ids.read().join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    first = grouped.groupBy("label").agg(F.min("first").alias("component_id"))
    by_print = grouped.join(first, "label").select("fp", "component_id")
    return rows.join(by_print, "fp").select("row", "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without all but one of each component of ``near_duplicates``: that with the smallest id stays.

    Rows without an id come last; of repeated rows one stays. Texts without words share fingerprint zero, so they
    are one group. All columns are kept, whatever their names.
    """
    # The place of a row in its component is its id for the operator, so that the smallest one names the row that stays.
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("no"))
    rows = Stage(numbered, "near-copies").read()
    own = F.col("row").getField(doc_id)
    placed = rows.select(F.struct(own.isNull().alias("none"), own.alias("id"), "no").alias("place"),
                         F.col("row").getField(text).alias("text"))
    found = near_duplicates(placed, "place", "text", radius)
    dropped = found.select(F.col("row.place.no").alias("no"), F.col("component_id.no").alias("stays")).filter("no <> stays")
    return rows.join(dropped.select("no"), "no", "left_anti").select("row.*")
