"""Rules on column names; they see schemas, never rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: words that mark a column's role ----------------------------
SCORE_WORDS = ("plausible", "math", "value")
SCHOOL_WORDS = ("school", "id")
STUDENT_WORDS = ("student", "id")
# Score columns kept by default when plausible values are dropped.
KEPT_SCORES = tuple(f"Plausible Value {n} in Mathematics" for n in range(1, 11))
# Column that joins always move to the end.
LAST_COLUMN = "Plausible Value 1 in Mathematics"
# Lower-case starts of column names that are dropped before modelling.
FINAL_PREFIX = "final"
SCORE_PREFIX = "plausible value"
# Marks that are removed from attribute names: the text \\v, control characters, backslashes.
ATTRIBUTE_NOISE = r"(\\v|[\x00-\x1F]|\\)+"
# ----------------------------------------------------------------------------

_HEADER_TABLE = str.maketrans({"'": " ", "\n": " ", "\r": " ", "\t": " ", ",": None, '"': None, "\\": None})


def column(name: str) -> Column:
    """Reference a column whose name may hold dots, blanks or back-ticks."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def clean_header(name: str) -> str:
    return name.translate(_HEADER_TABLE).strip()


def clean_attribute_name(name: str) -> str:
    return re.sub(ATTRIBUTE_NOISE, "", name).strip()


def unique_names(names: Iterable[str]) -> list[str]:
    """Make names distinct ignoring case: later copies get ``_2``, ``_3``, ..."""
    names = list(names)
    taken = set()
    reserved = {n.lower() for n in names}
    result = []
    for name in names:
        candidate, copy = name, 1
        while candidate.lower() in taken or (copy > 1 and candidate.lower() in reserved):
            copy += 1
            candidate = f"{name}_{copy}"
        taken.add(candidate.lower())
        result.append(candidate)
    return result


def rename_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*unique_names(names))


def clean_headers(df: DataFrame) -> DataFrame:
    return rename_all(df, [clean_header(n) for n in df.columns])


def clean_attribute_headers(df: DataFrame) -> DataFrame:
    return rename_all(df, [clean_attribute_name(n) for n in df.columns])


def squeeze(name: str) -> str:
    """Lower-case letters and digits only."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def words_of(name: str) -> set[str]:
    """The lower-case words of a name; every sign parts two words."""
    return set(re.findall(r"[a-z0-9]+", name.lower()))


def role_points(name: str, words: Sequence[str]) -> int:
    """Two points per whole word found, one per word found inside another."""
    whole, run = words_of(name), squeeze(name)
    return sum(2 if word in whole else 1 if word in run else 0 for word in words)


def role_candidates(names: Sequence[str], words: Sequence[str]) -> list[str]:
    """All columns that share the best positive number of points."""
    points = {name: role_points(name, words) for name in names}
    best = max(points.values(), default=0)
    return [name for name in names if best and points[name] == best]


def leveled_score_name(names: Sequence[str], score: str | None) -> str | None:
    """First column that carries the score's name and the word ``level``."""
    if not score:
        return None
    wanted = squeeze(score)
    return next((n for n in names if wanted in squeeze(n) and "level" in squeeze(n)), None)


def attribute_column(names: Sequence[str]) -> str:
    """Which column of a summary table holds the attribute names."""
    lowered = [(n, n.lower()) for n in names]
    rules = (
        lambda low: "attribute" in low and "name" in low,
        lambda low: low in ("attribute", "variable", "feature"),
        lambda low: "rank" not in low and "score" not in low,
    )
    for rule in rules:
        for name, low in lowered:
            if rule(low):
                return name
    return names[0]


def merge_key(left: Sequence[str], right: Sequence[str], wanted: Sequence[str] | None = None) -> str | None:
    """First wanted key both sides have, else the first common column in left order."""
    common = [n for n in left if n in set(right)]
    for key in wanted or ():
        if key in common:
            return key
    return common[0] if common else None


def common_names(left: Sequence[str], right: Sequence[str]) -> list[str]:
    """Names of ``left`` that ``right`` has too, order kept, copies removed."""
    other = set(right)
    return list(dict.fromkeys(n for n in left if n in other))


def unwanted_names(
    names: Sequence[str],
    user_drops: Iterable[str] = (),
    keep: Iterable[str] = KEPT_SCORES,
    score: str | None = None,
) -> list[str]:
    """Columns to drop before modelling: user choices, final weights, other scores."""
    kept = {k.lower() for k in keep}
    lowered = {n: n.lower() for n in names}
    chosen = [n for n in user_drops if n in lowered]
    weights = [n for n, low in lowered.items() if low.startswith(FINAL_PREFIX)]
    scores = [n for n, low in lowered.items() if low.startswith(SCORE_PREFIX) and low not in kept]
    return [n for n in dict.fromkeys([*chosen, *weights, *scores]) if n != score]


def slice_names(names: Sequence[str], ranges: Iterable[tuple[int, int]]) -> list[str]:
    return list(dict.fromkeys(n for start, end in ranges for n in names[start:end]))
