"""Secret scans: base patterns, and multipart credentials linked by an interval join within scopes.

Each text gives spans of three base kinds, which are always reported, and weaker candidates: account identifiers,
token-like secrets and service addresses. A weak candidate is reported only when a part of a complementary class
lies within ``SCOPE`` characters of it. The join runs on (text, scope cell), so it never pairs a whole text with
itself, and equal texts are joined once.

Defined results: a missing text counts as an empty one without spans; positions count code points, ends are
exclusive; repeated rows each get their spans; a missing id is carried along; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import Stage, let, text_digest, whole_text

SCOPE = 200
SUM_BLOCK = 256

ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# Kind: pattern, group whose length counts, least length. A run of the last two cannot hold a longer match than its
# own, so their least length is part of the pattern.
BASE = {
    "assign": (ASSIGN, 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 0),
    "hex": (r"[0-9a-f]{16,}", 0, 0),
}
WEAK = {
    "account": (
        r"""(?i)(?<![a-z0-9])(?:access_?key(?:_?id)?|client_?id|account(?:_?id)?|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}""",
        0, 0,
    ),
    "blob": (r"(?<![A-Za-z0-9+/=])(?=[A-Za-z+/]*[0-9])(?=[0-9a-z+/]*[A-Z])[A-Za-z0-9+/]{32,}={0,2}", 0, 0),
    "endpoint": (r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9][^\s\"'<>|]{3,}", 0, 0),
}
KINDS = (*BASE, *WEAK)
# Class of each kind, and the classes that make a weak one credible.
CLASS = {"assign": "secret", "access": "id", "hex": "secret", "account": "id", "blob": "secret", "endpoint": "place"}
NEEDS = {"account": ("secret",), "blob": ("id", "place"), "endpoint": ("secret",)}
SPAN = "struct<start:bigint,end:bigint>"


def _running(amounts: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What ``join`` makes of all amounts before each place, zero at first; in blocks, so that long arrays stay cheap."""

    def before(values: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("seen"))
        return F.aggregate(values, start, lambda s, x: F.struct(
            join(s["sum"], x).alias("sum"), F.array_append(s["seen"], s["sum"]).alias("seen")), lambda s: s["seen"])

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), join)

    def joined(blocks: Column) -> Column:
        return F.flatten(F.zip_with(
            F.transform(blocks, before), before(F.transform(blocks, total)),
            lambda block, offset: F.transform(block, lambda x: join(x, offset)),
        ))

    starts = F.sequence(F.lit(0), F.floor((F.size(amounts) - 1) / SUM_BLOCK).cast("int"))
    return F.when(F.size(amounts) == 0, F.array().cast("array<bigint>")).otherwise(
        let(F.transform(starts, lambda b: F.slice(amounts, b * SUM_BLOCK + 1, SUM_BLOCK)), joined)
    )


def running_sums(amounts: Column) -> Column:
    return _running(amounts, lambda a, b: a + b)


def find_spans(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost, non-overlapping matches as spans: their lengths and those of the pieces between them, summed up."""

    def placed(x: Column) -> Column:
        return F.zip_with(x, running_sums(F.transform(x, lambda y: y["gap"] + y["hit"])), lambda y, before: F.struct(
            (before + y["gap"]).alias("start"), (before + y["gap"] + y["hit"]).alias("end"), y["ok"].alias("ok")))

    def measured(x: Column) -> Column:
        lengths = F.zip_with(F.slice(x["pieces"], 1, F.size(x["hits"])), x["hits"], lambda piece, hit: F.struct(
            F.length(piece).cast("long").alias("gap"), F.length(hit).cast("long").alias("hit"), F.lit(True).alias("ok")))
        if least:
            lengths = F.zip_with(lengths, x["values"], lambda y, value: F.struct(
                y["gap"].alias("gap"), y["hit"].alias("hit"), (F.length(value) >= least).alias("ok")))
        return let(lengths, placed)

    facts = [
        F.split(text, pattern, -1).alias("pieces"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
    ]
    if least:
        facts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"))
    found = F.transform(
        F.filter(let(F.struct(*facts), measured), lambda s: s["ok"]),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")),
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _in_order(spans: Column) -> Column:
    return F.sort_array(spans)


def scan(docs: DataFrame, text: str = "text", row: str = "row") -> DataFrame:
    """``row`` (the input row without its text), the text's digest, and the spans of every kind as arrays."""
    content = whole_text(text)
    return docs.select(
        F.struct(*[F.col(c) for c in docs.columns if c != text]).alias(row), text_digest(content).alias("digest"),
        *[find_spans(content, *rule).alias(kind) for kind, rule in {**BASE, **WEAK}.items()],
    )


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(digest, kind, start, end)`` of the weak candidates with a complementary part in scope.

    Parts fall into cells of ``scope`` characters by where they start; a candidate looks into every cell that its
    scope touches. A part that reaches over a cell's border is listed in each cell it covers.
    """
    def parts(kinds) -> DataFrame:
        def named(kind: str) -> Column:
            return F.transform(F.col(kind), lambda s: F.struct(
                F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

        rows = [named(kind) for kind in kinds]
        flat = found.filter(" OR ".join(f"size({k}) > 0" for k in kinds)).select("digest", F.inline(F.concat(*rows)))
        return flat.dropDuplicates(["digest", "kind", "start"])

    def cells(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / scope), F.floor(last / scope)))

    def class_of(kind: Column) -> Column:
        return F.create_map(*[F.lit(x) for pair in CLASS.items() for x in pair])[kind]

    needs = F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    weak = parts(WEAK).select("*", cells(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope).alias("cell"))
    # Per text, cell and class the outermost parts decide whether any lies in scope; other parts of the cell lie between.
    other = parts(KINDS).select("digest", class_of(F.col("kind")).alias("class"), "start", "end",
                                cells(F.col("start"), F.col("end")).alias("cell"))
    outer = other.groupBy("digest", "cell", "class").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("parts"))
    pairs = weak.alias("w").join(outer.alias("o"), ["digest", "cell"]).filter(
        F.array_contains(needs[F.col("w.kind")], F.col("o.class"))
        & F.exists("o.parts", lambda p: (p["start"] <= F.col("w.end") + scope) & (p["end"] >= F.col("w.start") - scope))
    )
    return pairs.select("digest", "w.kind", "w.start", "w.end").distinct()


def find_secrets(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> tuple[DataFrame, Stage]:
    """``(row, digest, base, spans)``: the base spans and all reported spans as arrays of (start, place of the kind,
    end), in order; ``row`` holds the other columns. The second result is the table to drop after use."""
    stage = Stage(scan(docs, text), "secret-scan")
    found = stage.read()
    weak = linked(found, scope).select("digest", F.struct(
        "start", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int").alias("kind"), "end"
    ).alias("span")).groupBy("digest").agg(F.collect_list("span").alias("weak"))

    def of_kind(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind) + 1).alias("kind"), s["end"].alias("end")))

    base = _in_order(F.concat(*[of_kind(k) for k in BASE])).alias("base")
    strong = found.select("row", "digest", base, *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE])
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    result = strong.join(weak, "digest", "left").select(
        "row", "digest", *[f"n_{k}" for k in BASE], "base",
        _in_order(F.concat("base", F.coalesce("weak", none))).alias("spans"),
    )
    return result, stage


def spelled(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"] - 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


MASK = "[SECRET]"


def masked(text: Column, spans: Column) -> Column:
    """The text with every run of overlapping spans replaced by one mark; spans are in order."""

    def rebuilt(x: Column) -> Column:
        pieces = F.zip_with(x["spans"], x["seen"], lambda s, seen: F.when(
            s["start"] >= seen, F.concat(F.substring(x["text"], seen + 1, s["start"] - seen), F.lit(MASK))).otherwise(F.lit("")))
        last = F.array_max(F.transform(x["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), F.substring(x["text"], last + 1, F.length(x["text"])))

    facts = F.struct(text.alias("text"), spans.alias("spans"), _running(
        F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)).alias("seen"))
    return F.when(F.size(spans) > 0, let(facts, rebuilt)).otherwise(text)


def mask_secrets(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """The rows with all reported spans masked; all columns, a missing text stays missing."""
    found, _ = find_secrets(docs, text, scope)
    spans = found.filter(F.size("spans") > 0).select("digest", "spans").dropDuplicates(["digest"])
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), text_digest(whole_text(text)).alias("digest"))
    joined = rows.join(spans, "digest", "left")
    changed = F.when(F.col("spans").isNull(), F.col("row").getField(text)).otherwise(
        masked(F.col("row").getField(text), F.col("spans")))
    return joined.select(*[changed.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
