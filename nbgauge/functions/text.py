"""Small text expressions shared by the cell metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the metrics define it: the Unicode property plus the four
# ASCII separators, which Java's \s leaves out.  Needs the (?U) flag.
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"
# Letters, numbers of any script and the underscore.
WORD = r"[\p{L}\p{N}_]"


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def none() -> Column:
    """No occurrence; a metric looks for the fixed strings of its pattern first."""
    return F.lit(0).cast("bigint")


def occurrences(text: Column, piece: str) -> Column:
    """Non-overlapping occurrences of a fixed string.

    ``octet_length`` is a field read, so a piece that does not occur costs one
    byte scan and no copy.
    """
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(piece), F.lit("")))
    width = len(piece.encode())
    count = removed if width == 1 else F.call_function("div", removed, F.lit(width))
    return count.cast("bigint")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str) -> Column:
    """Number of matches of a regular expression."""
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def line_count(text: Column) -> Column:
    return occurrences(text, "\n") + F.lit(1).cast("bigint")


def lines(text: Column) -> Column:
    """All lines, trailing empty ones included; only ``\\n`` ends a line."""
    return F.split(text, "\n", -1)


def word_count(text: Column) -> Column:
    """Words separated by white space."""
    return matches(text, f"(?U){NOT_SPACE}+")
