"""Metrics of one markdown cell as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nbgauge.functions.text import line_count, matches, or_empty, word_count


def markdown_lines(source: Column) -> Column:
    """LMC: lines; 0 for NULL."""
    return F.when(source.isNull(), F.lit(0).cast("bigint")).otherwise(line_count(source))


def headers(source: Column, level: int) -> Column:
    """H1, H2, H3: marks of ``level`` at the text start, after a blank or after a line break.

    The blank behind a mark may open the next one, hence the lookahead.
    """
    text = or_empty(source)
    mark = "#" * level
    return F.startswith(text, F.lit(mark + " ")).cast("bigint") + matches(text, rf"[ \n]{mark}(?= )")


def markdown_words(source: Column) -> Column:
    """MW."""
    return word_count(or_empty(source))
