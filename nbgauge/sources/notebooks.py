"""Notebook files to cells, many files per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nbgauge.operators.texts import joined_cells


def read_notebook_files(spark: SparkSession, path: str, glob: str = "*.ipynb") -> DataFrame:
    """One row per file: an id made from its path, the path and the text."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    return notebook_rows(files.text(path))


def notebook_rows(files: DataFrame) -> DataFrame:
    """Id, path and text of a whole-text source, batch or stream."""
    path = F.col("_metadata.file_path")
    return files.select(F.xxhash64(path).alias("kernel_id"), path.alias("path"), F.col("value").alias("content"))


# Only these fields are read; outputs with their images are skipped over, so a
# large file costs little.  The two VARIANT fields may hold different types, and
# tell a missing key (NULL) from a null (a VARIANT).
NOTEBOOK = (
    "cells ARRAY<STRUCT<cell_type STRING, source VARIANT, outputs ARRAY<STRUCT<output_type STRING>>, "
    "execution_count VARIANT>>"
)


def _cell(cell: Column, position: Column) -> Column:
    """One cell; its index counts cells of all kinds from 1."""
    source = cell["source"]
    text = F.coalesce(
        F.array_join(F.try_variant_get(source, "$", "array<string>"), ""), F.try_variant_get(source, "$", "string")
    )
    return F.struct(
        (position + 1).cast("int").alias("cell_index"),
        cell["cell_type"].alias("cell_type"),
        text.alias("source"),
        # Only the first output is looked at.
        F.get(cell["outputs"], F.lit(0))["output_type"].alias("output_type"),
        F.try_variant_get(cell["execution_count"], "$", "int").alias("execution_count"),
        source.isNotNull().alias("has_source"),
        cell["execution_count"].isNotNull().alias("has_count"),
    )


def parse_notebooks(notebooks: DataFrame) -> DataFrame:
    """Add ``cells``, an array, and ``problem``, NULL if the notebook is sound.

    Works per notebook, without a shuffle.  A notebook with a cell of another
    kind, or with a code cell that lacks ``execution_count``, is not sound.
    """
    cells = F.transform(F.from_json("content", NOTEBOOK)["cells"], _cell)
    # One row in, one row out: filters on the cells stay above the generator, where
    # a plain column would be parsed again for each mention in a filter.
    parsed = notebooks.select("*", F.explode_outer(F.array(cells)).alias("cells"))
    odd_kind = F.exists("cells", lambda c: ~F.coalesce(c["cell_type"].isin("code", "markdown"), F.lit(False)))
    no_source = F.exists("cells", lambda c: ~c["has_source"])
    no_count = F.exists("cells", lambda c: (c["cell_type"] == "code") & ~c["has_count"])
    problem = (
        F.when(F.col("cells").isNull(), "no notebook")
        .when(odd_kind, "unknown cell type")
        .when(no_source, "cell without source")
        .when(no_count, "code cell without execution_count")
    )
    return parsed.withColumn("problem", problem).drop("content")


def sound_notebooks(parsed: DataFrame, mode: str = "quarantine") -> DataFrame:
    """Notebooks without a problem; ``mode='error'`` fails on the first other one."""
    if mode == "error":
        failed = F.raise_error(F.concat(F.lit("notebook "), F.col("kernel_id").cast("string"), F.lit(": "), "problem"))
        return parsed.withColumn("problem", F.when(F.col("problem").isNotNull(), failed.cast("string"))).where(
            F.col("problem").isNull()
        )
    return parsed.where(F.col("problem").isNull())


def rejected_notebooks(parsed: DataFrame) -> DataFrame:
    """Notebooks left out, with the reason."""
    return parsed.where(F.col("problem").isNotNull()).drop("cells")


def cells_of(parsed: DataFrame) -> DataFrame:
    """One row per cell of the sound notebooks."""
    return parsed.select("kernel_id", F.inline("cells")).drop("has_source", "has_count")


def code_cells_of(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("cell_type") == "code").drop("cell_type")


def markdown_cells_of(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("cell_type") == "markdown").select("kernel_id", "cell_index", "source")


def texts_of(parsed: DataFrame) -> DataFrame:
    """Code and markdown text of each notebook, straight from its cells."""

    def text(kind: str) -> Column:
        chosen = F.filter("cells", lambda c: c["cell_type"] == kind)
        return joined_cells(F.transform(chosen, lambda c: F.struct(c["cell_index"].alias("cell_index"), c["source"].alias("source"))))

    return parsed.select("kernel_id", text("code").alias("code"), text("markdown").alias("markdown"))
