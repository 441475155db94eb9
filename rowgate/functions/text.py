"""Text expressions. All of them are built-in functions and stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is stripped (29, the last is U+3000).
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# The same set as a character class of a Java regular expression.
WHITESPACE_CLASS = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Line ends, the full-width block and its half-width forms, texts for missing values.
LINE_BREAK = r"\r\n|[\x{0a}-\x{0d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
FULLWIDTH_FROM = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
FULLWIDTH_TO = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
EMPTY_DISPLAY = "（空）"
NO_OWNER = "（未填负责人）"
NO_VALUE = "—"
ELLIPSIS = "…"
SHOWN_CHARS = 60


def starts_visible(c: Column) -> Column:
    """True if the first character is seen to be no white space by comparing bytes: it is one of '!' to
    the end of ASCII, or comes after U+3000, the last white space. False leaves it open."""
    return F.coalesce(((c >= "!") & (c < "\u0080")) | (c >= "\u3001"), F.lit(False))


def strip(c: Column) -> Column:
    bare = starts_visible(c) & starts_visible(F.substring(c, -1, 1))
    return F.when(bare, c).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def is_blank_if_rare(c: Column) -> Column:
    """is_blank for tests that few rows come to; it takes less generated code."""
    return F.coalesce(F.btrim(c, F.lit(WHITESPACE)) == "", F.lit(True))


def is_blank(c: Column) -> Column:
    """True for NULL, '' and white space only."""
    return ~starts_visible(c) & is_blank_if_rare(c)


def to_halfwidth(c: Column) -> Column:
    """Full-width forms become half-width. Text without any, which is most, is not rebuilt."""
    ascii_only = F.octet_length(c) == F.length(c)
    has_fullwidth = ~ascii_only & c.rlike(r"[\x{ff01}-\x{ff5e}\x{3000}]")
    return F.when(has_fullwidth, F.translate(c, FULLWIDTH_FROM, FULLWIDTH_TO)).otherwise(c)


def dedup_key(c: Column) -> Column:
    """Comparison key of a cell: half-width, then stripped; '' when there is none. Case is kept."""
    return F.coalesce(strip(to_halfwidth(c)), F.lit(""))


def _shortened(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(ELLIPSIS))).otherwise(c)


def display_value(c: Column) -> Column:
    """Value as shown in load errors."""
    return F.when(is_blank(c), F.lit(EMPTY_DISPLAY)).otherwise(_shortened(c, SHOWN_CHARS))


def short_value(c: Column, limit: int = SHOWN_CHARS) -> Column:
    """Value as shown in validation errors: NULL is '', blanks are kept."""
    return F.coalesce(_shortened(c, limit), F.lit(""))


def clean_text(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def text_or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(default))


def first_line(c: Column) -> Column:
    """First line that is not blank, unstripped; NULL if there is none."""
    lines = F.filter(F.split(c, LINE_BREAK), lambda line: strip(line) != "")
    return F.try_element_at(lines, F.lit(1))


def contains_keyword(c: Column, keyword: str, trim_keyword: bool = False) -> Column:
    """Case-insensitive containment; an empty keyword matches everything."""
    word = keyword.strip() if trim_keyword else keyword
    return F.lower(c).contains(word.lower()) if word else F.lit(True)


def count_literal(c: Column, find: str) -> Column:
    """Occurrences of a literal, counted without overlap; NULL text counts 0."""
    removed = F.length(c) - F.length(F.replace(c, F.lit(find), F.lit("")))
    return F.coalesce((removed / len(find)).cast("bigint"), F.lit(0).cast("bigint"))


def replace_literal(c: Column, find: str, replacement: str) -> Column:
    """Case-sensitive replacement of a literal (not a pattern)."""
    return F.replace(c, F.lit(find), F.lit(replacement))
