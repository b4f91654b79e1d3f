"""Tree classifiers over notebook metrics: the library's learners, and those of Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nbgauge.operators import forest
from nbgauge.operators.boosting import SecondOrderBoosting, SymmetricBoosting
from nbgauge.operators.evaluation import classification_report, roc_auc
from nbgauge.operators.trees import TreeModel

NOT_FEATURES = ("KernelId", "kernel_id", "label", "split", "expert_score")


def boosted_trees_slow(**params) -> SymmetricBoosting:
    """Symmetric boosted trees, 100 rounds at a small rate."""
    return SymmetricBoosting(**params)


def boosted_trees_quick(**params) -> SymmetricBoosting:
    """Symmetric boosted trees, 10 rounds."""
    return SymmetricBoosting(**{"rounds": 10, "rate": 0.01, **params})


def boosted_trees_deep(**params) -> SecondOrderBoosting:
    """Boosted trees by second derivatives, 100 rounds at a large rate."""
    return SecondOrderBoosting(**params)


def decision_tree(**params) -> Estimator:
    return DecisionTreeClassifier(**{"maxDepth": 2, "seed": 0, **params})


def decision_tree_unbounded(**params) -> forest.DecisionTree:
    return forest.DecisionTree(**params)


def random_forest(**params) -> forest.ForestSearch:
    """Random forest, its shape found by a randomized, cross-validated search."""
    return forest.ForestSearch(**params)


CLASSIFIERS = {
    "cat_boost": boosted_trees_slow,
    "xg_boost": boosted_trees_deep,
    "decision_tree": decision_tree,
    "decision_tree_unbounded": decision_tree_unbounded,
    "random_forest": random_forest,
}


def classifier(name: str, **params):
    try:
        return CLASSIFIERS[name](**params)
    except KeyError:
        raise ValueError(f"unknown classifier {name}; one of {', '.join(CLASSIFIERS)}") from None


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES]


def train(df: DataFrame, estimator, features: Sequence[str] | None = None) -> Model | TreeModel:
    """Fit on all feature columns, or on the chosen ones."""
    chosen = list(features or feature_names(df))
    if not isinstance(estimator, Estimator):
        return estimator.fit(df, chosen)
    assembler = VectorAssembler(inputCols=chosen, outputCol="features")
    return Pipeline(stages=[assembler, estimator]).fit(df)


def predict(model: Model | TreeModel, df: DataFrame) -> DataFrame:
    """Add ``prediction`` (0/1) and ``score``, the probability of class 1."""
    if isinstance(model, TreeModel):
        return model.predict(df)
    scored = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*df.columns, F.col("prediction").cast("int").alias("prediction"), "score")


def evaluate(model: Model | TreeModel, df: DataFrame, label: str = "label") -> dict:
    """Report per class, averages and ``roc_auc_score``, as a plain dictionary."""
    scored = predict(model, df).select(label, "prediction", "score")
    report = {r["class"]: r.asDict() for r in classification_report(scored, label).collect()}
    report["roc_auc_score"] = roc_auc(scored, label).first()["roc_auc"]
    return report


def inputs_of(model: Model | TreeModel) -> list[str]:
    """The feature columns a model asks for."""
    if isinstance(model, TreeModel):
        return model.features
    return next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()


def feature_weights(model: Model | TreeModel) -> dict[str, float]:
    """Share of each feature in what the trees gained."""
    if isinstance(model, TreeModel):
        return model.importance()
    return dict(zip(inputs_of(model), model.stages[-1].featureImportances.toArray().tolist()))


def refit_best(model: TreeModel, df: DataFrame, trees: int = 500, seed: int = 42) -> TreeModel:
    """Grow a larger forest with the shape a search found best."""
    return forest.grown_larger(model, df, trees, seed)
