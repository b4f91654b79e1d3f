"""Popularity of imported names over a corpus, and the score of a cell's imports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from nbgauge.functions.code import import_groups, imported_names_of

# Largest popularity table that is shipped whole to the Python workers; about
# 20 MB.  A larger one is joined.
LOOKUP_ROWS = 200_000


def with_imports(cells: DataFrame, strict: bool = True) -> DataFrame:
    """Add the ``API`` list of each cell; the pattern runs once per cell."""
    found = cells.withColumn("_imports", import_groups(F.col("source")))
    # Known not to be NULL, so that no join derives a filter that works it out again.
    names = F.coalesce(imported_names_of(F.col("_imports"), strict), F.array().cast("array<string>"))
    return found.withColumn("API", names).drop("_imports")


def api_counts(cells: DataFrame) -> DataFrame:
    """Imports per name over all cells with an ``API`` list; repeats in a cell count.

    The counts are combined before the shuffle, so a name that most cells
    import costs one row per task.
    """
    # Not explode: the filter it implies would work out the list a second time.
    names = cells.select(F.explode_outer("API").alias("api")).where(F.col("api").isNotNull())
    return names.groupBy("api").agg(F.count(F.lit(1)).alias("n"))


def popularity_from_counts(counts: DataFrame, baseline: str = "sklearn") -> DataFrame:
    """Count of each name divided by the count of the baseline name.

    The baseline is looked up in the same aggregate (no filter that would push
    down and scan the corpus again), so its shuffle is reused.
    """
    found = counts.agg(F.max(F.when(F.col("api") == baseline, F.col("n")))).scalar()
    known = F.coalesce(found, F.raise_error(F.lit(f"baseline {baseline} is not imported anywhere")).cast("bigint"))
    return counts.select("api", (F.col("n") / known).alias("score"))


def api_popularity(cells: DataFrame, baseline: str = "sklearn") -> DataFrame:
    return popularity_from_counts(api_counts(cells), baseline)


def with_import_score(cells: DataFrame, popularity: DataFrame, lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Add ``EAP``: summed popularity of the distinct names a cell imports.

    Up to ``lookup_rows`` names (counted, never more are fetched) the table
    goes to the workers and no cell is shuffled.  Beyond it the scores are
    joined.  Both give the same values.
    """
    rows = popularity.select("api", "score").limit(lookup_rows + 1).toArrow()
    if rows.num_rows > lookup_rows:
        return join_import_score(cells, popularity)
    return cells.withColumn("EAP", _lookup(rows, cells.sparkSession)(F.array_distinct("API")))


def _lookup(rows: pa.Table, spark):
    rows = rows.combine_chunks()
    shared = spark.sparkContext.broadcast((rows["api"].to_pylist(), rows["score"].to_pylist()))

    @F.arrow_udf(DoubleType())
    def score_of_lists(lists: pa.Array) -> pa.Array:
        names, scores = shared.value
        at = pc.index_in(lists.flatten(), value_set=pa.array(names, lists.type.value_type))
        value = np.append(np.asarray(scores, dtype=float), 0.0)  # last entry: unknown name
        weights = value[pc.fill_null(at, len(names)).to_numpy(zero_copy_only=False)]
        cell = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        return pa.array(np.bincount(cell, weights=weights, minlength=len(lists)), pa.float64())

    return score_of_lists


def join_import_score(cells: DataFrame, popularity: DataFrame, salts: int = 32) -> DataFrame:
    """``EAP`` by join, for a popularity table of any size.

    The score depends on the import list alone, so it is worked out once per
    distinct list and joined to the cells by list.  Common lists are salted;
    cells without imports get a key of their own each and spread evenly.
    """
    # No filter on the lists: it would be pushed into the scan and work them out again.
    distinct = cells.select("API").distinct()
    scored = (
        distinct.select("API", F.explode_outer(F.array_distinct("API")).alias("api_name"))
        .join(popularity.select(F.col("api").alias("api_name"), "score"), "api_name", "left")
        .groupBy("API")
        .agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("EAP"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    )
    spread = F.xxhash64("kernel_id", "cell_index")
    salt = F.when(F.size("API") > 0, F.pmod(spread, F.lit(salts))).otherwise(spread)
    joined = cells.withColumn("_salt", salt).join(scored, ["API", "_salt"], "left").drop("_salt")
    return joined.select(*cells.columns, F.coalesce("EAP", F.lit(0.0)).alias("EAP"))
