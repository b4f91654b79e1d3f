"""Quality scores of notebooks from views, votes and reader comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nbgauge.operators.cleaning import complete_rows
from nbgauge.session import cut_lineage

COMMENT_KEYS = (
    "KernelId", "AuthorUserId", "UserName", "CurrentUrlSlug", "TotalViews", "TotalVotes",
    "PerformanceTier_kerneluser",
)
# Added to the comment part of a score, so that a notebook without comments
# still ranks by its views.
BASE_SCORE = 10


def _per_root_of_views(value: Column, views: Column) -> Column:
    """Value by the square root of views; no views makes it infinite, as later filters expect."""
    return F.when(views == 0, F.lit(float("inf"))).otherwise(F.try_divide(value, F.sqrt(views)))


def comment_scores(comments: DataFrame) -> DataFrame:
    """Comment totals and topic scores per notebook.

    Rows with a missing key column are left out.  Totals are combined before
    the shuffle, so a much discussed notebook is no heavy group.
    """
    totals = (
        complete_rows(comments, COMMENT_KEYS)
        .groupBy(*COMMENT_KEYS)
        .agg(
            F.coalesce(F.sum("CommentVote"), F.lit(0)).alias("CommentVote"),
            F.coalesce(F.sum("bert_score"), F.lit(0)).cast("double").alias("bert_score"),
        )
    )
    pure = F.col("bert_score") * (F.col("CommentVote") + 1)
    return totals.withColumn("pure_topic_score", pure).withColumn(
        "topic_score", _per_root_of_views(F.col("pure_topic_score") + BASE_SCORE, F.col("TotalViews"))
    )


def kernels_with_author(kernels: DataFrame, users: DataFrame) -> DataFrame:
    authors = users.select(F.col("Id").alias("AuthorUserId"), "UserName", "PerformanceTier")
    return kernels.join(authors, "AuthorUserId")


def measured_kernels(features: DataFrame, kernels: DataFrame) -> DataFrame:
    """Kernels that have metrics, with what is known about them."""
    facts = kernels.select(
        F.col("Id").alias("kernel_id"), "TotalVotes", "TotalViews", "CurrentUrlSlug", "UserName", "PerformanceTier"
    )
    return features.select("kernel_id").join(facts, "kernel_id")


def augment_with_kernels(scored: DataFrame, kernels: DataFrame) -> DataFrame:
    """Comment scores of all kernels, the facts of the kernel table preferred.

    A kernel without comments gets the base score by the root of its views.
    """
    left = scored.alias("x")
    right = kernels.withColumnRenamed("kernel_id", "KernelId").alias("y")
    joined = left.join(right, "KernelId", "full")
    fallback = _per_root_of_views(F.lit(float(BASE_SCORE)), F.col("y.TotalViews"))
    return joined.select(
        "KernelId",
        F.col("x.AuthorUserId").alias("AuthorUserId"),
        F.coalesce("y.PerformanceTier", "x.PerformanceTier_kerneluser").alias("PerformanceTier_kerneluser"),
        F.col("x.CommentVote").alias("CommentVote"),
        F.col("x.bert_score").alias("bert_score"),
        F.col("x.pure_topic_score").alias("pure_topic_score"),
        F.coalesce("x.topic_score", fallback).alias("topic_score"),
        *[F.coalesce(f"y.{c}", f"x.{c}").alias(c) for c in ("TotalViews", "TotalVotes", "UserName", "CurrentUrlSlug")],
    )


def drop_outliers(quality: DataFrame, votes_below: int = 500, score_below: float = 5) -> DataFrame:
    return quality.where((F.col("TotalVotes") < votes_below) & (F.col("topic_score") < score_below))


def scale_scores(quality: DataFrame, cut: bool = True) -> DataFrame:
    """Min-max scaled topic score and votes, and their sum.

    The extremes and the rows come from the same table, so its lineage is cut
    first (``cut=False`` if it is a written table already).
    """
    rows = cut_lineage(quality) if cut else quality
    columns = {"score_scaled": "topic_score", "vote_scaled": "TotalVotes"}
    # One row of four numbers, read back as constants.
    lows_highs = rows.agg(
        *[f(c).alias(f"{name}_{c}") for c in columns.values() for name, f in (("min", F.min), ("max", F.max))]
    ).first()

    def scaled(c: str) -> Column:
        low, high = F.lit(lows_highs[f"min_{c}"]), F.lit(lows_highs[f"max_{c}"])
        return F.try_divide(F.col(c) - low, high - low).cast("double")

    return rows.withColumns({name: scaled(c) for name, c in columns.items()}).withColumn(
        "combined_score", F.col("score_scaled") + F.col("vote_scaled")
    )


def with_votes_per_view(quality: DataFrame) -> DataFrame:
    """Add ``score``: (votes + 1) / views."""
    return quality.withColumn("score", F.try_divide(F.col("TotalVotes") + 1, F.col("TotalViews")).cast("double"))


# Fixed value: where the notebooks are published.
NOTEBOOK_ADDRESS = "https://www.kaggle.com/code/"


def with_url(rows: DataFrame, base: str = NOTEBOOK_ADDRESS) -> DataFrame:
    """Add the public address of a notebook."""
    return rows.withColumn("url", F.concat(F.lit(base), "UserName", F.lit("/"), "CurrentUrlSlug", F.lit("/notebook")))
