"""Whitespace, line, rounding and binding helpers shared by the other column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character sequence that ends a line of text, CRLF first.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

#: All characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A lambda variable is never re-evaluated, whereas an expression repeated inside a
    higher-order function would be computed again for every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def collapse(text: Column) -> Column:
    """Whitespace runs become one blank, the ends are cut."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def lines(text: Column) -> Column:
    """Array of lines; a final line end does not open another line."""
    return F.split(F.regexp_replace(text, rf"(?:{LINE_END})\z", ""), LINE_END)


def words(text: Column) -> Column:
    """Whitespace-separated tokens."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda token: token != "")


def word_count(text: Column) -> Column:
    """Number of whitespace-separated tokens."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def captured(text: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, or null when the pattern does not match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def round_exact(value: Column, digits: int) -> Column:
    """Round the exact binary value of a double, ties to even.

    ``round`` works on the shortest decimal form instead, so 2.675 would become 2.68.
    """
    pattern = "0." + "0" * digits
    return F.call_function("format_number", value, F.lit(pattern)).cast("double")
