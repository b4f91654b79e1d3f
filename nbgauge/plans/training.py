"""Training sets, training jobs and batch scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nbgauge.operators.cleaning import METRICS_FILTERS, SCORES_FILTERS, clean_experts, clean_features, clean_scores, features_only
from nbgauge.operators.learning import classifier as classifier_by_name, evaluate, inputs_of, predict, train
from nbgauge.operators.notebook import apply_filters
from nbgauge.operators.ordering import balanced_head, random_split, select_extremes
from nbgauge.operators.registry import ModelRegistry
from nbgauge.operators.trees import TreeModel
from nbgauge.session import cut_lineage


def scored_features(
    features: DataFrame, scores: DataFrame, metrics_filters: Sequence[str] = (), scores_filters: Sequence[str] = ()
) -> DataFrame:
    """Cleaned features with the scores of their notebook."""
    left = apply_filters(clean_scores(scores), scores_filters)
    right = apply_filters(clean_features(features), metrics_filters)
    return left.join(right, "KernelId")


def training_set(
    features: DataFrame,
    scores: DataFrame,
    metrics_filters: Sequence[str] = (),
    scores_filters: Sequence[str] = (),
    split_factor: float = 0.7,
    selection_ratio: float = 0.25,
    sort_by: str = "combined_score",
    include_pt: bool = True,
    test_fraction: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """Features of the worst and the best notebooks with ``label`` and ``split``.

    The selected rows are written once: training reads them many times.
    """
    # Written once, as the ranks and the rows must come from equal reads.
    joined = cut_lineage(scored_features(features, scores, metrics_filters, scores_filters))
    ends = cut_lineage(select_extremes(joined, sort_by, split_factor, selection_ratio))
    return features_only(random_split(ends, test_fraction, seed=seed), include_pt)


def expert_test_set(
    features: DataFrame, experts: DataFrame, metrics_filters: Sequence[str] = (), include_pt: bool = True
) -> DataFrame:
    """Features of as many good as bad notebooks, judged by experts, with ``label``."""
    right = apply_filters(clean_features(features), metrics_filters)
    judged = clean_experts(experts).join(right, "KernelId")
    rows = features_only(balanced_head(judged), include_pt, drop=("KernelId", "TYPE"))
    return rows.withColumn("expert_score", F.col("expert_score").cast("int")).withColumnRenamed("expert_score", "label")


def train_job(
    features: DataFrame,
    scores: DataFrame,
    registry: ModelRegistry,
    file_name: str,
    classifier: str = "cat_boost",
    experts: DataFrame | None = None,
    metrics_filters: Sequence[str] | str = "default",
    scores_filters: Sequence[str] | str = "default",
    sort_by: str = "combined_score",
    split_factor: float = 0.7,
    selection_ratio: float = 0.25,
    include_pt: bool = False,
    metrics: Sequence[str] | None = None,
    params: dict | None = None,
) -> tuple[str, dict]:
    """Train, test, save and register a model; its id and its reports.

    Filters are predicates or the name of a predicate set.  ``metrics`` trains
    on a choice of the metrics.
    """
    on_metrics = METRICS_FILTERS[metrics_filters] if isinstance(metrics_filters, str) else list(metrics_filters)
    on_scores = SCORES_FILTERS[scores_filters] if isinstance(scores_filters, str) else list(scores_filters)
    data = training_set(features, scores, on_metrics, on_scores, split_factor, selection_ratio, sort_by, include_pt)
    model = train(data.where(F.col("split") == "train"), classifier_by_name(classifier, **(params or {})), metrics)
    reports = {"default": evaluate(model, data.where(F.col("split") == "test")), "experts": None}
    if experts is not None:
        reports["experts"] = evaluate(model, expert_test_set(features, experts, on_metrics, include_pt))
    key = registry.save(
        model,
        file_name,
        classifier,
        notebook_metrics_filters=on_metrics,
        notebook_scores_filters=on_scores,
        sort_by=sort_by,
        split_factor=split_factor,
        selection_ratio=selection_ratio,
        include_pt=include_pt,
        features=inputs_of(model),
        metrics=reports,
    )
    return key, reports


def score_notebooks(model: Model | TreeModel, notebooks: DataFrame, pt: int | None = None) -> DataFrame:
    """Prediction for each notebook.

    A model trained with the author's tier needs ``pt``, or a ``PT`` column.
    """
    rows = notebooks.withColumnRenamed("ALLC", "ALLCL")
    if pt is not None:
        rows = rows.withColumn("PT", F.lit(pt))
    missing = [c for c in inputs_of(model) if c not in rows.columns]
    if missing:
        raise ValueError(f"the model needs {', '.join(missing)}")
    return predict(model, rows).select("kernel_id", "prediction", "score")
