"""Notebook texts: the code and the markdown of a notebook as one text each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = " \n "


def joined_cells(cells: Column) -> Column:
    """Texts of an array of (cell_index, source), in cell order."""
    return F.array_join(F.transform(F.array_sort(cells), lambda c: F.coalesce(c["source"], F.lit(""))), SEPARATOR)


def assemble_texts(cells: DataFrame) -> DataFrame:
    """``code`` and ``markdown`` text of each notebook, from rows with a ``cell_type``.

    One row per notebook.  Cells without an id belong to none and are left out;
    cells with one index are ordered by their source.
    """

    def texts(kind: str) -> Column:
        cell = F.struct("cell_index", "source")
        return joined_cells(F.collect_list(F.when(F.col("cell_type") == kind, cell)))

    keyed = cells.where(F.col("kernel_id").isNotNull())
    return keyed.groupBy("kernel_id").agg(texts("code").alias("code"), texts("markdown").alias("markdown"))


def text_pairs(texts: DataFrame, markdown_length: int = 300) -> DataFrame:
    """Truncated markdown in front of the code, as a text classifier reads a notebook."""
    short = F.left(F.coalesce("markdown", F.lit("")), F.lit(markdown_length))
    return texts.withColumn("markdown", short).withColumn("text", F.concat_ws("\n", "markdown", "code"))
