"""Quality table of notebooks: comments, kernels, scores, and samples for experts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nbgauge.operators.ordering import head_and_tail, sample_rows, select_symmetric
from nbgauge.operators.scores import (
    augment_with_kernels,
    comment_scores,
    drop_outliers,
    kernels_with_author,
    measured_kernels,
    scale_scores,
    with_url,
    with_votes_per_view,
)


def kernel_facts(features: DataFrame, kernels: DataFrame, users: DataFrame) -> DataFrame:
    """What is known of each kernel that has metrics."""
    return measured_kernels(features.select("kernel_id").distinct(), kernels_with_author(kernels, users))


def augmented_quality(comments: DataFrame, facts: DataFrame) -> DataFrame:
    """Comment scores of all kernels, before outliers are dropped."""
    return augment_with_kernels(comment_scores(comments), facts)


def kernel_quality(comments: DataFrame, facts: DataFrame) -> DataFrame:
    """The score table: outliers dropped, scores scaled and combined."""
    return scale_scores(drop_outliers(augmented_quality(comments, facts)))


def expert_sample(
    quality: DataFrame, min_views: int = 500, fraction: float = 0.10, per_class: int = 525, seed: int = 42
) -> DataFrame:
    """Notebooks for experts to judge: a sample of each end of the combined score."""
    ends = select_symmetric(quality.where(F.col("TotalViews") > min_views), fraction)
    low = sample_rows(ends.where(F.col("label") == 0), per_class, seed=seed)
    high = sample_rows(ends.where(F.col("label") == 1), per_class, seed=seed)
    return with_url(low.unionByName(high)).select(
        "KernelId", "TotalViews", "UserName", "TotalVotes", "CurrentUrlSlug", "score_scaled", "vote_scaled",
        "combined_score", "label", "url",
    )


def text_model_sample(quality: DataFrame, rows: int = 10_000, min_views: int = 500) -> DataFrame:
    """Notebooks for a text model: the ends of the votes per view."""
    seen = with_votes_per_view(quality.where(F.col("TotalViews") >= min_views))
    return head_and_tail(seen, rows // 2, "score")
