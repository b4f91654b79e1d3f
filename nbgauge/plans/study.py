"""The whole quality study as one job: comments to scores to a sample for experts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nbgauge.operators.cleaning import clean_comments, in_language, topic_label, with_language
from nbgauge.operators.evaluation import criterion_report
from nbgauge.operators.textmodel import keep_class, predict_text, train_text_model
from nbgauge.plans.quality import expert_sample, kernel_facts, kernel_quality

CRITERIA = ("topic_score", "vote_scaled", "combined_score")


def stage(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a stage of the study and go on from the written table."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def score_comments(
    comments: DataFrame, sheet: DataFrame, ad_topic: str = "advertise", topic: str = "comperenension",
    train: Callable = train_text_model, **params
) -> tuple[DataFrame, DataFrame]:
    """Comments without advertisements, and the same with ``bert_score`` (0/1) of a topic model.

    Both models are trained on the labelled sheet; the topic model on its rows
    that are no advertisements.
    """
    ad_model = train(topic_label(sheet, ad_topic), "Text", **params)
    topic_model = train(topic_label(sheet, topic, ad_topic), "Text", **params)
    no_ads = keep_class(ad_model, comments)
    scored = predict_text(topic_model, no_ads, "Text").withColumn("bert_score", F.col("prediction").cast("double"))
    return no_ads, scored.drop("prediction")


def run_study(
    spark: SparkSession,
    folder: str,
    comments: DataFrame,
    sheet: DataFrame,
    features: DataFrame,
    kernels: DataFrame,
    users: DataFrame,
    experts: DataFrame | None = None,
    detect: Callable[[pd.Series], pd.DataFrame] | None = None,
    per_class: int = 525,
    **params,
) -> dict[str, DataFrame]:
    """All stages, each a table under ``folder``; the tables by name."""
    cleaned = clean_comments(comments)
    if detect is not None:
        cleaned = in_language(with_language(cleaned, detect)).drop("lang", "lang_conf")
    tables = {"comments": stage(cleaned, folder, "comments")}
    no_ads, scored = score_comments(tables["comments"], sheet, **params)
    tables["comments_no_ad"] = stage(no_ads, folder, "comments_no_ad")
    tables["comments_scored"] = stage(scored, folder, "comments_scored")
    facts = kernel_facts(features, kernels, users)
    tables["quality"] = stage(kernel_quality(tables["comments_scored"], facts), folder, "quality")
    tables["expert_sample"] = stage(expert_sample(tables["quality"], per_class=per_class), folder, "expert_sample")
    if experts is not None:
        reports = [
            criterion_report(tables["quality"], experts, c).withColumn("criterion", F.lit(c)) for c in CRITERIA
        ]
        tables["reports"] = stage(reports[0].unionByName(reports[1]).unionByName(reports[2]), folder, "reports")
    return tables
