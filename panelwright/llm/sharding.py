"""K-d tree partitioning: shards of nearly equal bytes, cut at weighted medians of metadata.

The dimensions are the size's logarithm and the metadata, numbers by value and texts by the order of their bytes, each
scaled by the range of its values. Equal texts form a group with the sum of their sizes as weight, so that copies stay together; only a group that is
too heavy for even shards is cut up by id. A node is cut at the weighted median of its widest dimension. Every
median comes from a few counting passes: the sums of at most ``BINS`` bins per node reach the driver, and the next
pass looks into the bin that holds the median, first by coordinate and then by the group's hash, so ties are cut
evenly too.

Defined results: a missing text has size one and equals other missing or empty texts; missing metadata and
numbers that are not finite lie at coordinate zero; of a group's metadata the least place counts; rows without id or repeated rows are rows of their group like any other; an empty table has no
shards. Other columns are carried along in ``row``.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.common import Stage, whole_text
from panelwright.operators.positions import with_row_number

DIGIT = 12
BINS = 1 << DIGIT
# Digits of a coordinate, and of the hash that orders equal coordinates.
PLACE_DIGITS, HASH_DIGITS = 2, 4
# A group heavier than this share of a shard is cut up.
SPLIT_SHARE = 0.04
# A bin lighter than this share of a shard is not looked into.
EVEN_SHARE = 0.002
# The greatest coordinate, and the bytes of a text that make its coordinate.
BELOW_ONE = 1 - 2.0**-30
TEXT_BYTES = 6


def _kind_of(docs: DataFrame, name: str) -> str:
    return "double" if isinstance(docs.schema[name].dataType, (T.NumericType, T.BooleanType)) else "string"


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def _scaled(value: Column, low: float, high: float) -> Column:
    """A number as a place in [0, 1) of its dimension's range; missing is zero."""
    if not high > low:
        return F.lit(0.0)
    return F.when(value.isNull(), 0.0).otherwise(F.least((value - low) / F.lit(high - low), F.lit(BELOW_ONE)))


def _place(value: Column, low: float | str | None, high: float | str | None) -> Column:
    """A number, or a text by the order of its bytes, as a place in the range of all values.

    Of texts the bytes behind the prefix that the least and the greatest share count, so all share it.
    """
    if low is None or high is None:
        return F.lit(0.0)
    if not isinstance(low, str):
        return _scaled(value, low, high)
    ends = [low.encode(), high.encode()]
    shared = len(commonprefix(ends))
    first, last = (float(int.from_bytes(end[shared : shared + TEXT_BYTES].ljust(TEXT_BYTES, b"\0"), "big")) for end in ends)
    behind = F.hex(F.substring(value.cast("binary"), shared + 1, TEXT_BYTES))
    return _scaled(F.conv(F.rpad(behind, 2 * TEXT_BYTES, "0"), 16, 10).cast("double"), first, last)


def _units(rows: DataFrame, target: float, places: list[Column]) -> DataFrame:
    """Groups of equal texts and how many parts heavy ones are cut into: key, parts, coordinates in [0, 1)."""
    groups = rows.groupBy("key").agg(F.sum("size").alias("weight"), *[F.min(c).alias(f"c{k}") for k, c in enumerate(places)])
    parts = F.ceil(F.col("weight") / F.lit(max(1.0, SPLIT_SHARE * target))).cast("int").alias("parts")
    return groups.select("key", parts, *[f"c{k}" for k in range(len(places))])


def shards(
    docs: DataFrame, levels: int = 3, doc_id: str = "doc_id", text: str = "text",
    metadata: tuple[str, ...] = ("source", "lang"),
) -> DataFrame:
    """``(row, size, text_crc32, shard, slot)`` for 2 ** levels shards; ``row`` is the input row without its text.

    The number of levels follows from the target bytes per leaf: ``levels = ceil(log2(bytes / target))``.
    """
    content = whole_text(text)
    size = F.octet_length(content).cast("long") + 1
    kinds = [_kind_of(docs, n) for n in metadata]
    listed = docs.select(
        F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("row"), size.alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.struct(size.alias("size"), F.crc32(content.cast("binary")).alias("crc"), F.xxhash64(content).alias("hash")).alias("key"),
        F.xxhash64(F.col(doc_id).cast("string")).alias("id_hash"), *[
            (_finite(F.col(n).cast("double")) if kind == "double" else F.col(n).cast("string")).alias(f"meta{k}")
            for k, (n, kind) in enumerate(zip(metadata, kinds))],
    )
    stage = Stage(listed, "shard-rows")
    rows = stage.read()
    # Dimensions: the size's logarithm and the metadata, each with the range of its values.
    dims = [F.log2("size"), *[F.col(f"meta{k}") for k in range(len(metadata))]]
    total, *ends = rows.agg(F.sum("size"), *[end(d) for d in dims for end in (F.min, F.max)]).first()
    target = (total or 0) / 2**levels
    units = _units(rows, target, [_place(d, *ends[2 * k : 2 * k + 2]) for k, d in enumerate(dims)])
    part = F.when(F.col("parts") > 1, F.pmod(F.col("id_hash"), F.col("parts"))).otherwise(F.lit(0)).cast("int")
    # The weight of a part is the sum over its own rows.
    parted = rows.join(units.filter("parts > 1").select("key", "parts"), "key", "left").withColumn(
        "part", F.coalesce(part, F.lit(0))).drop("parts")
    parted_stage = Stage(parted, "shard-parts")
    parted = parted_stage.read()
    weights = parted.groupBy("key", "part").agg(F.sum("size").alias("weight"))
    nodes = Stage(weights.join(units.drop("parts"), "key").select(
        "key", "part", "weight", F.xxhash64("key", "part").alias("order"), *[f"c{k}" for k in range(len(dims))],
    ), "shard-units")
    node = cut_nodes(nodes.read(), levels, len(dims), EVEN_SHARE * target)
    placed = parted.join(nodes.read().select("key", "part", node.alias("shard")), ["key", "part"])
    numbered = with_row_number(
        placed.select("row", "size", "text_crc32", "shard", "id_hash", F.col("key.hash").alias("h")),
        ["shard"], [F.col("h"), F.col("id_hash")], "slot")
    return numbered.select("row", "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"))


def _digits(dim: int) -> list[Column]:
    """Coordinate, then hash, as digits of ``DIGIT`` bits, most significant first."""
    place = F.floor(F.col(f"c{dim}") * float(BINS**PLACE_DIGITS)).cast("long")
    order = F.shiftrightunsigned(F.col("order"), 64 - DIGIT * HASH_DIGITS)
    return [
        F.shiftright(source, DIGIT * k).bitwiseAND(BINS - 1)
        for source, n in ((place, PLACE_DIGITS), (order, HASH_DIGITS)) for k in reversed(range(n))
    ]


def _above(digits: list[Column], cut: list[int]) -> Column:
    """Is the row beyond the cut? The cut's last bin itself lies below."""
    beyond = F.lit(False)
    for digit, at in reversed(list(zip(digits, cut))):
        beyond = (digit > at) | ((digit == at) & beyond)
    return beyond


def cut_nodes(units: DataFrame, levels: int, dims: int, even: float) -> Column:
    """The leaf of a unit, as an expression over its coordinates: one comparison per level of the tree."""
    node = F.lit(0)
    for _ in range(levels):
        at = units.withColumn("node", node)
        wide = at.groupBy("node").agg(
            F.sum("weight").alias("weight"), *[(F.max(f"c{k}") - F.min(f"c{k}")).alias(f"w{k}") for k in range(dims)]
        ).collect()  # one row per node
        dim = {r["node"]: max(range(dims), key=lambda k, r=r: (r[f"w{k}"], -k)) for r in wide}
        half = {r["node"]: r["weight"] / 2 for r in wide}
        below = dict.fromkeys(dim, 0)
        cut: dict[int, list[int]] = {n: [] for n in dim}
        unsettled = set(dim)
        for step in range(PLACE_DIGITS + HASH_DIGITS):
            if not unsettled:
                break
            value, inside = F.lit(None).cast("long"), F.lit(False)
            for n in unsettled:
                digits = _digits(dim[n])
                value = F.when(F.col("node") == n, digits[step]).otherwise(value)
                same = F.col("node") == n
                for digit, c in zip(digits, cut[n]):
                    same = same & (digit == c)
                inside = inside | same
            sums = at.filter(inside).groupBy("node", value.alias("bin")).agg(F.sum("weight").alias("weight"))
            rows = sorted(sums.collect())  # at most BINS rows per node
            for n in list(unsettled):
                bins = [(b, w) for m, b, w in rows if m == n]
                for b, w in bins:
                    if below[n] + w >= half[n] or b == bins[-1][0]:
                        last = step == PLACE_DIGITS + HASH_DIGITS - 1
                        if w <= even or last:
                            # The bin goes to the side that leaves the halves more even.
                            lower = below[n] + w - half[n] <= half[n] - below[n]
                            cut[n].append(b if lower else b - 1)
                            unsettled.discard(n)
                        else:
                            cut[n].append(b)
                        break
                    below[n] += w
        side = F.lit(0)
        for n in dim:
            side = F.when(node == n, F.when(_above(_digits(dim[n]), cut[n]), 1).otherwise(0)).otherwise(side)
        node = (node * 2 + side).cast("int")
    return node
