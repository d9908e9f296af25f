"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Defined results: a missing text counts as an empty one; an empty text has no words and fails the base rule;
repeated rows are judged one by one; other columns are carried along unread, whatever their names.
Three-word windows are compared by a 64-bit hash within one text.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import let, split_words, whole_text

WINDOW = 3
SYMBOLS = "[#*$%&|<>]"
# Frequent function words of the corpus languages.
STOP_WORDS = (
    "the", "and", "of", "to", "a", "in", "that", "is", "with", "be", "have", "was", "are", "on", "for", "it", "as",
    "de", "la", "el", "le", "les", "et", "un", "une", "des", "que", "dans", "est", "pour", "y", "en", "los", "las",
    "se", "no", "es", "del", "por", "con", "para", "der", "die", "das", "und", "zu", "den", "von", "ist", "nicht",
    "ein", "mit", "sich", "im", "dem", "auf", "als",
)


class Rule(NamedTuple):
    """A text passes when low <= 1000 * amount / per <= high; ``None`` leaves a side open."""

    amount: str
    per: str
    low: int | None
    high: int | None


RULES = (
    Rule("word_chars", "n_words", 2000, 12000),
    Rule("n_symbols", "n_words", None, 100),
    Rule("n_stop_words", "n_words", 20, None),
    Rule("n_dup_lines", "n_lines", None, 500),
)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window which the text holds twice or more."""

    def covered(places: Column) -> Column:
        # A window covers up to the next repeated window, three words at most; the last one covers three.
        steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(F.lit(WINDOW), b - a))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def repeated(pairs: Column) -> Column:
        same = F.filter(
            pairs,
            lambda p, k: F.coalesce(
                (p["h"] == F.get(pairs, k - 1)["h"]) | (p["h"] == F.get(pairs, k + 1)["h"]),
                p["h"] == F.get(pairs, k - 1)["h"],
                p["h"] == F.get(pairs, k + 1)["h"],
                F.lit(False),
            ),
        )
        return let(F.sort_array(F.transform(same, lambda p: p["i"])), covered)

    def counted(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, repeated))

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
    )
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(hashes, counted))


def _line_facts(text: Column) -> Column:
    """Lines with a word, and those equal to an earlier one."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda kept: F.struct(
        F.size(kept).cast("long").alias("n_lines"),
        (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"),
    ))


def _word_facts(text: Column) -> Column:
    return let(split_words(text), lambda words: F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        _repeat_words(words).cast("long").alias("n_repeat_words"),
    ))


def measured(text: Column) -> Column:
    """Every amount the rules use, as one struct."""
    return let(
        F.struct(text.alias("t"), _word_facts(text).alias("w"), _line_facts(text).alias("l")),
        lambda x: F.struct(
            *[x["w"][n].alias(n) for n in ("n_words", "word_chars", "n_stop_words", "n_repeat_words")],
            *[x["l"][n].alias(n) for n in ("n_lines", "n_dup_lines")],
            F.regexp_count(x["t"], F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        ),
    )


def base_failed(amounts: Column) -> Column:
    return (amounts["n_words"] < 50) | (100 * amounts["n_repeat_words"] > 50 * amounts["n_words"])


def passes(amounts: Column, rules: Sequence[Rule] = RULES) -> Column:
    """All rules of the table as one condition."""
    verdict = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            verdict = verdict & (1000 * amounts[rule.amount] >= rule.low * amounts[rule.per])
        if rule.high is not None:
            verdict = verdict & (1000 * amounts[rule.amount] <= rule.high * amounts[rule.per])
    return verdict


def kept(amounts: Column, rules: Sequence[Rule] = RULES) -> Column:
    return ~base_failed(amounts) & passes(amounts, rules)


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows whose text passes, with all their columns."""
    return docs.filter(let(measured(whole_text(text)), lambda m: kept(m, rules)))
