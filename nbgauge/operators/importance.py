"""What a fitted model looks at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nbgauge.operators.learning import feature_weights, inputs_of, predict
from nbgauge.operators.ordering import with_global_rank
from nbgauge.operators.trees import TreeModel


def model_importance(model: Model | TreeModel, df: DataFrame) -> DataFrame:
    """Importance of each feature as the trees report it."""
    return df.sparkSession.createDataFrame(list(feature_weights(model).items()), "feature string, importance double")


def permutation_importance(
    model: Model | TreeModel, df: DataFrame, label: str = "label", seed: int = 42, features: Sequence[str] | None = None
) -> DataFrame:
    """Accuracy lost when the values of one feature are shuffled among the rows.

    Every row is paired with one other row at random, by two random orders of
    the table.  It is then scored once as it is and once per feature with that
    value taken from its partner: one pass for all features, and only counts
    are shuffled.
    """
    inputs = inputs_of(model)
    chosen = list(features or inputs)
    wide = df.select(label, *inputs)
    here = with_global_rank(wide.withColumn("_o", F.xxhash64(F.lit(seed), *inputs)), "_o", rank="_at").drop("_o")
    there = with_global_rank(
        wide.select(*[F.col(c).alias(f"_other_{c}") for c in inputs], F.xxhash64(F.lit(seed + 1), *inputs).alias("_o")),
        "_o",
        rank="_at",
    ).drop("_o")

    def variant(shuffled: str | None):
        values = [F.col(f"_other_{c}" if c == shuffled else c).cast("double").alias(c) for c in inputs]
        return F.struct(F.lit(shuffled).alias("feature"), F.col(label).alias("label"), *values)

    variants = here.join(there, "_at").select(F.inline(F.array(variant(None), *[variant(c) for c in chosen])))
    hits = (
        predict(model, variants)
        .groupBy("feature")
        .agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
    )
    # One row per feature from here on.
    base = F.max(F.when(F.col("feature").isNull(), F.col("accuracy"))).over(Window.partitionBy(F.lit(1)))
    compared = hits.withColumn("importance", base - F.col("accuracy"))
    return compared.where(F.col("feature").isNotNull()).select("feature", "accuracy", "importance")
