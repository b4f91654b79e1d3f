"""Text classifiers for comments and for notebook texts.

``train`` is the learner: word counts with a linear model (``train_text_model``), or
``subwords.train_subword_model``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nbgauge.operators.evaluation import binary_report, classification_report
from nbgauge.operators.ordering import balanced_head, sample_rows, three_way_split
from nbgauge.operators.subwords import SubwordModel
from nbgauge.operators.texts import text_pairs


def text_pipeline(text_col: str = "text", buckets: int = 1 << 16, max_iter: int = 10) -> Pipeline:
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"(?U)\w+", gaps=False),
            HashingTF(inputCol="_words", outputCol="_counts", numFeatures=buckets),
            IDF(inputCol="_counts", outputCol="features"),
            LogisticRegression(maxIter=max_iter, regParam=0.01),
        ]
    )


def _filled(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn(text_col, F.coalesce(text_col, F.lit("")))


def train_text_model(df: DataFrame, text_col: str = "text", **params) -> PipelineModel:
    """Fit on a text column and ``label``."""
    return text_pipeline(text_col, **params).fit(_filled(df, text_col).select(text_col, "label"))


def predict_text(model: PipelineModel | SubwordModel, df: DataFrame, text_col: str = "text") -> DataFrame:
    scored = model.transform(_filled(df, text_col))
    return scored.select(*df.columns, F.col("prediction").cast("int").alias("prediction"))


def keep_class(model: PipelineModel | SubwordModel, df: DataFrame, text_col: str = "Text", wanted: int = 0) -> DataFrame:
    """Rows the model puts into one class."""
    return predict_text(model, df, text_col).where(F.col("prediction") == wanted).drop("prediction")


def train_topic_model(
    sheet: DataFrame, eval_fraction: float = 0.13, test_fraction: float = 0.25, seed: int = 1, train: Callable = train_text_model, **params
) -> tuple[PipelineModel | SubwordModel, DataFrame]:
    """Fit on a labelled sheet (Id, Text, label); the model and its report on the test part."""
    parts = three_way_split(sheet, eval_fraction, test_fraction, "Id", seed)
    model = train(parts.where(F.col("split") == "train"), "Text", **params)
    tested = predict_text(model, parts.where(F.col("split") == "test"), "Text")
    return model, classification_report(tested)


def filter_comments(comments: DataFrame, ad_model: PipelineModel | SubwordModel, topic_model: PipelineModel | SubwordModel, topic_class: int = 0):
    """Comments without advertisements, and those of them in one class of the topic model."""
    no_ads = keep_class(ad_model, comments)
    return no_ads, keep_class(topic_model, no_ads, wanted=topic_class)


def learning_curve(
    texts: DataFrame,
    holdout: DataFrame | None = None,
    sizes: Sequence[int] = (1000, 2000, 4000, 8000, 10000),
    id_col: str = "KernelId",
    seed: int = 1,
    train: Callable = train_text_model,
    **params,
) -> DataFrame:
    """Accuracy, and precision, recall and F1 of both classes, of the notebook text model by size of the sample.

    ``texts`` holds markdown, code and label.  Each size is one training job
    over a sample; rows of the result are collected figures, two per size.
    """
    pairs = text_pairs(texts)
    figures = []
    for size in sizes:
        parts = three_way_split(sample_rows(pairs, size, id_col, seed), 0.10, 0.25, id_col, seed)
        model = train(parts.where(F.col("split") == "train"), **params)
        tests = {"test": parts.where(F.col("split") == "test")}
        if holdout is not None:
            tests["experts"] = text_pairs(holdout)
        for name, rows in tests.items():
            figures.append((size, name, *binary_report(predict_text(model, rows)).first()))
    per_class = ", ".join(f"precision_{c} double, recall_{c} double, f1_{c} double, support_{c} bigint" for c in (0, 1))
    return texts.sparkSession.createDataFrame(figures, f"size int, test_set string, accuracy double, {per_class}")


def balanced_texts(texts: DataFrame, id_col: str = "KernelId") -> DataFrame:
    return balanced_head(texts, "label", id_col)
