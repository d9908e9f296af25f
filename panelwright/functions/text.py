"""Text and value expressions; every function maps a Column to a Column."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelwright.functions.names import ATTRIBUTE_NOISE

# --- fixed values -----------------------------------------------------------
# Tokens a CSV scan reads as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# Labels that stand for a missing answer.
MISSING_LABELS = ("Missing", "Invalid", "N/A")
# Numeric codes above this limit stand for a missing answer.
SENTINEL_LIMIT = 9990.0
# Text that counts as a number.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Characters of code page 1252 at 0x80-0x9F; bytes 81, 8D, 8F, 90, 9D are unassigned.
CP1252_BYTES = (
    "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e"
    "\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
)
CP1252_CHARACTERS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
# All characters that count as white space when text is stripped.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# ----------------------------------------------------------------------------


def strip(c: Column | str) -> Column:
    """Remove white space of every kind at both ends.

    Most values need blanks removed at most, which is much cheaper than trimming by
    a character set: the set is used only when an end is no printable ASCII character.
    """
    text = F.col(c) if isinstance(c, str) else c
    blanks_gone = F.trim(text)
    plain = F.left(blanks_gone, F.lit(1)).between("!", "~") & F.right(blanks_gone, F.lit(1)).between("!", "~")
    return F.when(plain, blanks_gone).otherwise(F.btrim(text, F.lit(WHITESPACE)))


def strip_once(c: Column | str) -> Column:
    """Same as :func:`strip`, with its text named once: for small tables, where nested steps would make the plan grow."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITESPACE))


def array_from(items: Column | str, start: int) -> Column:
    """The elements of an array from the 1-based place ``start`` on; evaluates the array once."""
    return F.filter(items, lambda _, place: place >= start - 1)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def from_cp1252(latin1: Column) -> Column:
    """Correct text that was read as ISO-8859-1 but written as code page 1252."""
    return F.translate(latin1, CP1252_BYTES, CP1252_CHARACTERS)


def to_cp1252(c: Column) -> Column:
    """Inverse of :func:`from_cp1252`, for writing through ISO-8859-1."""
    return F.translate(c, CP1252_CHARACTERS, CP1252_BYTES)


def clean_value(c: Column) -> Column:
    """Quotes and line breaks become blanks; commas, double quotes and backslashes go."""
    return strip(F.translate(c, "'\n\r\t" + ',"\\', "    "))


def escape_newlines(c: Column) -> Column:
    """Each line break becomes the two characters ``\\n``."""
    mark = F.lit("\\n")
    return strip(F.replace(F.replace(c, F.lit("\n"), mark), F.lit("\r"), mark))


def clean_attribute(c: Column) -> Column:
    """Drop ``\\v`` marks, control characters and backslashes from a name."""
    return F.trim(F.regexp_replace(c, ATTRIBUTE_NOISE, ""))


def tokens_to_null(c: Column, tokens: Iterable[str]) -> Column:
    return F.when(c.isin(*tokens), None).otherwise(c)


def sentinel_to_null(c: Column, limit: float = SENTINEL_LIMIT) -> Column:
    return F.when(c > limit, None).otherwise(c)


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)


def parse_number(c: Column) -> Column:
    """Double value of the text, NULL when the text is not a plain number."""
    return F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double"))


def is_whole_number(c: Column) -> Column:
    """True for text that is an integer within 64 bits; NULL for a missing one."""
    whole = c.rlike(r"^\s*[+-]?\d{1,19}\s*$") & c.try_cast("bigint").isNotNull()
    return F.when(c.isNotNull(), whole)


def is_bad_number(c: Column) -> Column:
    """True for a value that is present but not a number; NULL for a missing one."""
    return ~c.rlike(NUMBER_PATTERN)


def fixed_width_field(line: Column, start: int, end: int) -> Column:
    """Characters ``start``..``end`` (1-based, inclusive), stripped, blank as NULL."""
    return blank_to_null(strip(F.substring(line, start, end - start + 1)))


def starts_with_code(line: Column, code: str | None) -> Column:
    """Case-sensitive line prefix test; an empty code keeps every line."""
    return line.startswith(code) if code else F.lit(True)


@lru_cache
def _sources_of_upper() -> dict[str, list[str]]:
    """Upper-cased ASCII text to the single characters that have it as upper case."""
    sources: dict[str, list[str]] = {}
    for character in map(chr, range(0x10000)):
        upper = character.upper()
        if upper.isascii():
            sources.setdefault(upper, []).append(character)
    return sources


def spellings(code: str) -> list[str]:
    """Every text whose upper case is the given upper-case code."""
    if not code:
        return [""]
    sources = _sources_of_upper()
    return [c + rest for k in (1, 2, 3) if k <= len(code) for c in sources.get(code[:k], ()) for rest in spellings(code[k:])]


def equals_code(c: Column, code: str) -> Column:
    """Case-insensitive equality; NULL does not match.

    For a short code all spellings are listed: a list of values reaches the Parquet
    reader, which skips row groups by it, while ``upper(c) = code`` does not.
    """
    upper = code.upper()
    if upper.isascii() and 0 < len(upper) <= 4:
        return c.isin(*spellings(upper))
    return F.upper(c) == upper


def year_of_name(name: Column) -> Column:
    """Text after the last underscore of a data set name."""
    tail = F.element_at(F.split(name, "_"), -1)
    return F.when(name.isNotNull() & (name != ""), tail).otherwise(F.lit("unknown_year"))
