"""Filters, projections and repairs of the feature, score, expert and comment tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Named predicate sets.
METRICS_FILTERS = {
    "default": ["LOC < 1000"],
    "ML_based": ["TYPE = 'ML'", "LOC < 1000"],
}
SCORES_FILTERS = {
    "default": ["TotalViews >= 500"],
    "ML_based": ["TYPE = 'ML'", "TotalViews >= 500"],
}

SCORE_COLUMNS = (
    "KernelId", "TotalViews", "TotalVotes", "PerformanceTier_kerneluser", "topic_score", "score_scaled",
    "vote_scaled", "combined_score",
)
# Columns of the joined training table that are no features.
TEXT_COLUMNS = ("TYPE",)
ID_AND_SCORE_COLUMNS = (*SCORE_COLUMNS, *TEXT_COLUMNS)

SHORT_NAMES = {"NVD": "VDT", "NEC": "EC", "OPRATOR": "OPRAT", "UOPRATOR": "UOPRAT"}

# Cells that mark a broken feature row.
BROKEN_ROW_MARKS = {"MC": "Unnamed: 27", "MeanWMC": "0.0.1", "H2": "0.0.1", "H3": "0.0.1"}


def _as_number(name: str) -> Column:
    return F.col(f"`{name}`").try_cast("double").alias(name)


def complete_rows(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Rows without NULL in the given columns, or in any.

    One predicate per column: the single predicate of ``na.drop`` over many
    columns makes the planner derive a variant per subset of renamed columns.
    """
    for name in columns or df.columns:
        df = df.where(F.col(f"`{name}`").isNotNull())
    return df


def clean_features(features: DataFrame) -> DataFrame:
    """Distinct rows, every column but the id (and text tags) a number, no NULL left."""
    kept = ("kernel_id", *TEXT_COLUMNS)
    rows = features.dropDuplicates()
    rows = rows.select(*[F.col(c) if c in kept else _as_number(c) for c in rows.columns])
    return complete_rows(rows).withColumnRenamed("kernel_id", "KernelId")


def clean_scores(scores: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    """Distinct score rows whose four scores are numbers."""
    numbers = ["combined_score", "TotalVotes", "score_scaled", "vote_scaled"]
    rows = scores.select(*SCORE_COLUMNS, *extra).dropDuplicates()
    return complete_rows(rows.withColumns({c: F.col(c).try_cast("double") for c in numbers}), numbers)


def clean_experts(experts: DataFrame) -> DataFrame:
    """Distinct expert scores that are numbers."""
    rows = experts.select("KernelId", "expert_score").dropDuplicates()
    return complete_rows(rows.withColumn("expert_score", F.col("expert_score").try_cast("double")), ["expert_score"])


def features_only(df: DataFrame, include_pt: bool = True, drop: Iterable[str] = ID_AND_SCORE_COLUMNS) -> DataFrame:
    """Drop ids and scores, optionally the tier, and give ``ALLC`` its model name."""
    rows = df.drop(*drop) if include_pt else df.drop(*drop, "PT")
    return rows.withColumnRenamed("ALLC", "ALLCL")


def rename_short(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(SHORT_NAMES)


def drop_broken_rows(df: DataFrame, marks: Mapping[str, str] = BROKEN_ROW_MARKS) -> DataFrame:
    """Drop rows that hold a mark in its column; NULL is no mark."""
    for name, mark in marks.items():
        if name in df.columns:
            df = df.where(~F.col(name).cast("string").eqNullSafe(mark))
    return df


def text_columns_to_double(df: DataFrame, keep: Iterable[str] = (), strict: bool = False) -> DataFrame:
    """Make the remaining text columns numbers; ``strict`` fails on other text."""
    names = [f.name for f in df.schema if isinstance(f.dataType, StringType) and f.name not in set(keep)]
    cast = (lambda c: F.col(c).cast("double")) if strict else (lambda c: F.col(c).try_cast("double"))
    return df.withColumns({c: cast(c) for c in names}) if names else df


def one_row_per_key(df: DataFrame, key: str = "kernel_id") -> DataFrame:
    """One row per key: the least by column order.

    A minimum is combined before the shuffle, so a key that holds a large part
    of the rows is no heavy group.
    """
    rest = [c for c in df.columns if c != key]
    least = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))
    return least.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def distinct_complete_rows(df: DataFrame) -> DataFrame:
    return complete_rows(df).dropDuplicates()


# -- comments -----------------------------------------------------------------


def not_by_author(comments: DataFrame) -> DataFrame:
    """Drop comments of the notebook's author; an unknown side counts as different."""
    same = F.col("DisplayName_kerneluser") == F.col("DisplayName_commentuser")
    return comments.where(~F.coalesce(same, F.lit(False)))


def with_text(comments: DataFrame, max_length: int = 256) -> DataFrame:
    """Comments with a text of at most ``max_length`` characters."""
    return comments.where(F.col("Text").isNotNull() & (F.length("Text") <= max_length))


def without_links(comments: DataFrame) -> DataFrame:
    return comments.where(~F.coalesce(F.contains("Message", F.lit("<a")), F.lit(False)))


def in_language(
    rows: DataFrame, language: str = "en", confidence: float = 0.7, lang_col: str = "lang", conf_col: str = "lang_conf"
) -> DataFrame:
    """Drop rows that are in another language with more than the given confidence."""
    other = (F.col(conf_col) > confidence) & ~F.contains(F.col(lang_col), F.lit(language))
    return rows.where(~F.coalesce(other, F.lit(False)))


def with_language(
    rows: DataFrame, detect: Callable[[pd.Series], pd.DataFrame], text_col: str = "Text"
) -> DataFrame:
    """Add ``lang`` and ``lang_conf`` by a detector of the caller's.

    ``detect`` takes a batch of texts and returns the two columns; it runs on
    the executors.  Line breaks are blanks to it.
    """

    @F.pandas_udf("lang string, lang_conf double")
    def detector(texts: pd.Series) -> pd.DataFrame:
        found = detect(texts)
        found.columns = ["lang", "lang_conf"]
        return found

    found = detector(F.replace(F.col(text_col), F.lit("\n"), F.lit(" ")))
    # Behind a generator, so that a filter on the result does not run the detector again.
    detected = rows.withColumn("_found", found).withColumn("_lang", F.explode_outer(F.array("_found")))
    return detected.select(*rows.columns, "_lang.lang", "_lang.lang_conf")


def clean_comments(comments: DataFrame, max_length: int = 256) -> DataFrame:
    """Comments of others, with a short text and no link."""
    return without_links(with_text(not_by_author(comments), max_length))


def topic_label(sheet: DataFrame, topic: str, drop_topic: str | None = None) -> DataFrame:
    """Sheet with one 0/1 column per topic to a binary ``label`` of one topic.

    Missing marks are 0.  ``drop_topic`` removes the rows of another topic.
    """
    rows = sheet.na.fill(0)
    if drop_topic:
        rows = rows.where(~F.col(drop_topic).eqNullSafe(1))
    return rows.select("Id", "Text", F.col(topic).eqNullSafe(1).cast("int").alias("label"))


def complete_texts(rows: DataFrame) -> DataFrame:
    """Rows with code; other missing texts are empty."""
    return rows.na.drop(subset=["code"]).na.fill("")
