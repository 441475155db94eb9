"""Date text: normalisation and parsing as built-in expressions.

Accepted after normalisation (date separators '-', '/', '.'; one- or two-digit month and day):
    y-m-d | y-m-d H:M | y-m-d H:M:S | y-m-d-H:M | y-m-d-H:M:S
Time separators after a blank may be ':' or '.', and blanks inside the time are ignored. The
time of day is checked and then dropped.

Most cells are yyyy-MM-dd, which a cast settles; other ASCII spellings take one pattern. Only text
that holds other characters goes through the folding branch, which maps every character whose
compatibility form can be part of a date.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowgate.functions.text import WHITESPACE, WHITESPACE_CLASS

_DATE_CHARS = set("0123456789-/.:")


def _pattern(digit: str, zero: str, blank: str) -> str:
    """Whole-value pattern; group 1 is the date part. `digit` is the class of any digit, `zero` that
    of any zero (there is no year 0).

    A one-digit day may be set off by blanks ('2024/1/ 5'); then a time can only follow after '-'."""
    b = f"{blank}*"
    month = rf"(?!{zero}{{4}}){digit}{{4}}[-/.](?:1[0-2]|0[1-9]|[1-9])[-/.]"
    day = f"3[01]|[12]{digit}|0[1-9]|[1-9]"
    attached = rf"[-/.](?:2[0-3]|[01]{digit}|{digit}):(?:[0-5]{digit}|{digit})(?::(?:[0-5]{digit}|{digit}))?"
    hour = f"2{b}[0-3]|[01]{b}{digit}|{digit}"
    sixty = f"[0-5]{b}{digit}|{digit}"
    time = rf"(?:{hour}){b}[:.]{b}(?:{sixty})(?:{b}[:.]{b}(?:{sixty}))?"
    usual = rf"(?:{day})(?:{attached}|{blank}+{time})?"
    set_off = rf"{blank}+[1-9](?:{b}-{b}{time})?"
    return rf"\A{b}(?={month}(?:{usual}|{set_off}){b}\z)({month}{b}{digit}{{1,2}})"


@functools.cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """Folding by rule: white space becomes a blank, and a character whose compatibility form
    consists of date characters becomes that form. Returns (from, to) of the one-character folds
    and the longer ones, numbers such as circled 12, as a dict. Forms of full stops alone cannot
    be part of a date and stay."""
    single, longer = {}, {}
    for code in range(0x80, 0x20000):
        ch = chr(code)
        form = " " if ch in WHITESPACE else unicodedata.normalize("NFKC", ch) if unicodedata.decomposition(ch) else ""
        if len(form) == 1 and form in _DATE_CHARS | {" "}:
            single[ch] = form
        elif form.rstrip(".").isdigit() and form.isascii():
            longer[ch] = form
    return "".join(single), "".join(single.values()), longer


@functools.cache
def _other_digits() -> tuple[str, str, str, str]:
    """Decimal digits outside ASCII that have no compatibility form: they are accepted where any
    digit is. Returns (digits, their ASCII values, class of all digits, class of all zeros)."""
    digits = [
        chr(c)
        for c in range(0x80, min(sys.maxunicode, 0x1FFFF) + 1)
        if unicodedata.category(chr(c)) == "Nd" and unicodedata.normalize("NFKC", chr(c)) == chr(c)
    ]
    values = "".join(str(unicodedata.decimal(d)) for d in digits)
    zeros = [d for d in digits if unicodedata.decimal(d) == 0]
    ranges = "".join(rf"\x{{{ord(z):x}}}-\x{{{ord(z) + 9:x}}}" for z in zeros)
    return "".join(digits), values, f"[0-9{ranges}]", f"[0{''.join(zeros)}]"


def _fold(c: Column) -> Column:
    """One pattern replaces the numbers: the list of signs and numbers is put behind the text, each
    sign looks ahead for its number there, and the list itself is replaced by nothing."""
    single_from, single_to, longer = _folding()
    listed = "\0" + "".join(f"{ch}={form}," for ch, form in longer.items())
    pattern = rf"(?s)([{''.join(longer)}])(?=.*\x{{0}}.*\1=([0-9.]+),)|\Q{listed}\E\z"
    numbers = F.regexp_replace(F.concat(c, F.lit(listed)), pattern, "$2")
    return F.translate(numbers, single_from, single_to)


def _as_date(date_part: Column) -> Column:
    """'2024/1/5' -> date; NULL for '' and for days the calendar does not have."""
    return F.translate(date_part, "/." + WHITESPACE, "--").try_cast("date")


def usual_date(c: Column) -> Column:
    """Date of the usual spelling, yyyy-MM-dd: text that comes back unchanged from a cast. Years
    outside 1 to 9999 are written with a sign and sort below '0001'."""
    date = c.try_cast("date")
    return F.when((c >= "0001") & (date.cast("string") == c), date)


def parse_date(c: Column) -> Column:
    """Date of a text cell, or NULL."""
    digits, values, any_digit, any_zero = _other_digits()
    ascii_date = F.regexp_extract(c, _pattern("[0-9]", "0", WHITESPACE_CLASS), 1)
    folded = F.regexp_extract(_fold(c), _pattern(any_digit, any_zero, WHITESPACE_CLASS), 1)
    other_date = F.when(c.rlike(r"[^\x{00}-\x{7f}]"), F.translate(folded, digits, values))
    # No match is '', which sorts below a match; when both patterns match, it is the same date.
    return F.coalesce(usual_date(c), _as_date(F.greatest(ascii_date, other_date)))


def normalize_date_text(c: Column) -> Column:
    """Date text in the form the parser accepts: first word with '-' separators, then the other
    words joined, with ':' separators. '' stays ''; NULL stays NULL."""
    ascii_blanks = F.translate(_fold(c), WHITESPACE, " " * len(WHITESPACE))
    text = F.btrim(ascii_blanks, F.lit(" "))
    date = F.translate(F.substring_index(text, " ", 1), "/.", "--")
    rest = F.regexp_replace(F.regexp_extract(text, r"\A[^ ]* (.*)\z", 1), " ", "")
    return F.when(rest == "", date).otherwise(F.concat(date, F.lit(" "), F.translate(rest, ".", ":")))

