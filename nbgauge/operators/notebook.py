"""Notebook metrics: aggregates of cell metrics and the joins between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from nbgauge import schemas

# Fixed value: id of rows that are no notebook.
MARKER_ID = "train_emb"


def _key_is_text(df: DataFrame) -> bool:
    return isinstance(df.schema["kernel_id"].dataType, StringType)


def clean_kernel_id(df: DataFrame, drop_bad_ids: bool = False) -> DataFrame:
    """Drop marker rows and make the id a number.

    An id that is no number becomes 0, as does every other NULL of the row;
    ``drop_bad_ids`` removes such rows instead.  An id that is a number already
    is left as it is, so that the partitioning of a grouped table still serves
    the next join.
    """
    metrics = [c for c in df.columns if c != "kernel_id"]
    if not _key_is_text(df):
        known = df.where(F.col("kernel_id").isNotNull()) if drop_bad_ids else df
        return known.na.fill(0, subset=metrics)
    df = df.where(F.col("kernel_id").isNull() | (F.col("kernel_id") != MARKER_ID))
    df = df.withColumn("kernel_id", F.col("kernel_id").try_cast("bigint"))
    if drop_bad_ids:
        df = df.where(F.col("kernel_id").isNotNull())
    return df.na.fill(0)


def clean_cell_index(df: DataFrame) -> DataFrame:
    """Drop marker rows and make the cell index a number, 0 if it is none."""
    if _key_is_text(df):
        df = df.where(F.col("kernel_id").isNull() | (F.col("kernel_id") != MARKER_ID))
    return df.withColumn("cell_index", F.col("cell_index").try_cast("double").try_cast("int")).na.fill(0)


def _total(metric: str, chosen: Column | None) -> Column:
    return F.coalesce(F.sum(_if(chosen, metric)), F.lit(0)).alias(metric)


def _if(chosen: Column | None, metric: str) -> Column:
    return F.col(metric) if chosen is None else F.when(chosen, F.col(metric))


def _code_aggregates(chosen: Column | None = None) -> list[Column]:
    return [
        *[_total(m, chosen) for m in schemas.CODE_SUMS],
        *[F.avg(_if(chosen, m)).alias(name) for m, name in schemas.CODE_MEANS.items()],
        *[F.max(_if(chosen, m)).alias(name) for m, name in schemas.CODE_MAXIMA.items()],
        F.count(_if(chosen, "LOC")).alias("CC"),
    ]


def _markdown_aggregates(chosen: Column | None = None) -> list[Column]:
    return [
        F.count(_if(chosen, "H1")).alias("MC"),
        *[F.avg(_if(chosen, m)).alias(name) for m, name in schemas.MARKDOWN_MEANS.items()],
        *[_total(m, chosen) for m in schemas.MARKDOWN_SUMS],
    ]


def code_notebook_metrics(cell_metrics: DataFrame, drop_bad_ids: bool = False, min_loc: int = 1) -> DataFrame:
    """Sums, means, maxima and the count of the code cells of each notebook.

    One aggregate, combined before its only shuffle.  Ids are cleaned after it,
    so ids that are no numbers do not fall into one group.  Notebooks of at
    most ``min_loc`` lines are left out.
    """
    rows = cell_metrics.where(F.col("kernel_id").isNotNull())
    return finished_code_metrics(rows.groupBy("kernel_id").agg(*_code_aggregates()), drop_bad_ids, min_loc)


def finished_code_metrics(grouped: DataFrame, drop_bad_ids: bool = False, min_loc: int = 1) -> DataFrame:
    """Clean ids of aggregated notebooks, without those of at most ``min_loc`` lines."""
    return clean_kernel_id(grouped, drop_bad_ids).where(F.col("LOC") > min_loc)


def markdown_notebook_metrics(cell_metrics: DataFrame, drop_bad_ids: bool = False) -> DataFrame:
    """Count, means and sums of the markdown cells of each notebook.

    Ids are cleaned before the aggregate: one row per id, so that a join with
    the code metrics never multiplies them, however many ids are no numbers.
    """
    rows = cell_metrics.where(F.col("kernel_id").isNotNull())
    if _key_is_text(rows):
        known = F.col("kernel_id").try_cast("bigint")
        rows = rows.where(F.col("kernel_id") != MARKER_ID).withColumn("kernel_id", known if drop_bad_ids else F.coalesce(known, F.lit(0)))
        rows = rows.where(F.col("kernel_id").isNotNull())
    return clean_kernel_id(rows.groupBy("kernel_id").agg(*_markdown_aggregates()), drop_bad_ids)


def mixed_notebook_metrics(cell_metrics: DataFrame, min_loc: int = 1) -> DataFrame:
    """Notebook metrics from rows with a ``cell_type`` and the metrics of both kinds.

    The same rows as a full join of the two tables above, from one aggregate.
    """
    is_code, is_markdown = F.col("cell_type") == "code", F.col("cell_type") == "markdown"
    rows = cell_metrics.where(F.col("kernel_id").isNotNull())
    grouped = rows.groupBy("kernel_id").agg(*_code_aggregates(is_code), *_markdown_aggregates(is_markdown))
    has_code = F.col("LOC") > min_loc
    kept = grouped.where(has_code | (F.col("MC") > 0))
    code = [F.when(has_code, F.col(m)).otherwise(F.lit(0)).alias(m) for m in schemas.CODE_NOTEBOOK_METRICS]
    return kept.select("kernel_id", *code, *schemas.MARKDOWN_NOTEBOOK_METRICS).na.fill(0, subset=list(schemas.NOTEBOOK_METRICS))


def join_notebook_metrics(code: DataFrame, markdown: DataFrame, how: str = "left") -> DataFrame:
    """Code and markdown metrics of a notebook side by side, 0 where one is missing.

    ``how`` is ``left`` for a corpus and ``full`` for uploaded notebooks, where
    one with markdown only stays.
    """
    return code.join(markdown, "kernel_id", how).na.fill(0)


def join_author_tier(notebooks: DataFrame, user_pt: DataFrame) -> DataFrame:
    """Add the author's tier by a left join on all shared columns."""
    shared = [c for c in notebooks.columns if c in user_pt.columns]
    joined = notebooks.join(user_pt, shared, "left").na.fill(0)
    return joined.withColumn("kernel_id", F.col("kernel_id").cast("bigint"))


def prepare_author_tier(user_pt: DataFrame) -> DataFrame:
    """Rename the columns of a tier table and drop its index column."""
    return user_pt.withColumnsRenamed({"Id_x": "kernel_id", "PerformanceTier": "PT"}).drop("Unnamed: 0")


def drop_repeated_cells(cells: DataFrame) -> DataFrame:
    """Keep one of the cells delivered more than once: the least, so that a rerun keeps the same."""
    keys = ["kernel_id", "cell_index"]
    if cells.isStreaming or set(cells.columns) == set(keys):
        return cells.dropDuplicates(keys)
    rest = F.struct(*[c for c in cells.columns if c not in keys])
    return cells.groupBy(*keys).agg(F.min(rest).alias("_least")).select(
        *[F.col(c) if c in keys else F.col(f"_least.{c}").alias(c) for c in cells.columns]
    )


def apply_filters(df: DataFrame, filters) -> DataFrame:
    """Rows for which all SQL predicates hold."""
    return reduce(lambda rows, predicate: rows.where(F.expr(predicate)), filters, df)
