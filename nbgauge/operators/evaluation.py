"""Agreement and evaluation statistics, and table profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nbgauge.operators.ordering import split_at_rank


def fleiss_kappa(
    ratings: DataFrame, raters: Sequence[str], categories: Sequence[int] = (0, 1), standard: bool = False
) -> DataFrame:
    """Fleiss' kappa over complete rows, as one row.

    By default the share of a category counts unanimous rows only, as published
    values have it; ``standard=True`` uses all ratings.
    """
    k = len(raters)
    rows = ratings.na.drop(subset=list(raters)).select(*[F.col(f"`{r}`").cast("int").alias(f"_r{i}") for i, r in enumerate(raters)])
    votes = {c: sum(((F.col(f"_r{i}") == c).cast("int") for i in range(k)), F.lit(0)) for c in categories}
    rows = rows.select(*[v.alias(f"_c{c}") for c, v in votes.items()])
    squares = sum((F.col(f"_c{c}") * F.col(f"_c{c}") for c in categories), F.lit(0))
    counted = [(F.col(f"_c{c}") if standard else (F.col(f"_c{c}") == k).cast("int")) for c in categories]
    totals = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((squares - k) / (k * (k - 1))).alias("observed"),
        *[F.sum(v).alias(f"_p{c}") for c, v in zip(categories, counted)],
    )
    share = [F.try_divide(F.col(f"_p{c}"), F.col("n") * k) for c in categories]
    expected = sum((p * p for p in share), F.lit(0.0))
    return totals.withColumn("expected", expected).select(
        "n", "observed", "expected", F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected")).alias("kappa")
    )


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and averages.

    Rows: one per class, ``accuracy``, ``macro avg``, ``weighted avg``.  All but
    the first aggregate run over as many rows as there are class pairs.
    """
    pairs = df.groupBy(F.col(label).cast("int").alias("t"), F.col(prediction).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(zero)

    def side(c: str, actual: Column, predicted: Column, hits: Column) -> Column:
        return F.struct(
            F.col(c).alias("c"), actual.alias("actual"), predicted.alias("predicted"), hits.alias("hits")
        )

    sides = F.array(side("t", F.col("n"), zero, hit), side("p", zero, F.col("n"), zero))
    classes = (
        pairs.select(F.inline(sides))
        .groupBy("c")
        .agg(F.sum("actual").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
        .select(
            "c",
            "support",
            "hits",
            F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0)).alias("precision"),
            F.coalesce(F.try_divide("hits", "support"), F.lit(0.0)).alias("recall"),
            F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("predicted")), F.lit(0.0)).alias("f1"),
        )
    )
    measures = ("precision", "recall", "f1")
    accuracy = F.try_divide(F.sum("hits"), F.sum("support"))

    def summary(name: str, value) -> DataFrame:
        return classes.agg(*[value(m).alias(m) for m in measures], F.sum("support").alias("support")).select(
            F.lit(name).alias("class"), *measures, "support"
        )

    per_class = classes.select(F.col("c").cast("string").alias("class"), *measures, "support")
    return (
        per_class.unionByName(summary("accuracy", lambda m: accuracy))
        .unionByName(summary("macro avg", lambda m: F.avg(m)))
        .unionByName(
            summary("weighted avg", lambda m: F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")))
        )
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact area under the ROC curve, ties counted half, as one row.

    Rows are combined per score first.  The scores are then cut into ranges:
    pairs inside a range come from a running sum in the range, pairs across
    ranges from the totals of the ranges, of which there are as many as shuffle
    partitions.
    """
    positive = (F.col(label) == 1).cast("bigint")
    per_score = (
        df.select(F.col(score).cast("double").alias("s"), positive.alias("pos"), (1 - positive).alias("neg"))
        .na.drop()
        .groupBy("s")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    ranges = per_score.repartitionByRange("s").withColumn("part", F.spark_partition_id())
    below = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2)
    totals = (
        ranges.withColumn("won", inside)
        .groupBy("part")
        .agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    # One row per range from here on.
    lower = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pairs = F.col("won") + F.col("pos") * F.coalesce(F.sum("neg").over(lower), F.lit(0))
    return (
        totals.withColumn("pairs", pairs)
        .agg(F.sum("pairs").alias("pairs"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
        .select(
            "positives",
            "negatives",
            F.try_divide(F.col("pairs"), F.col("positives").cast("double") * F.col("negatives")).alias("roc_auc"),
        )
    )


def criterion_report(
    quality: DataFrame, experts: DataFrame, criterion: str, split_factor: float = 0.5
) -> DataFrame:
    """How well the median split of a score agrees with the expert scores."""
    prediction = f"binary_{criterion}"
    halves = split_at_rank(quality, criterion, split_factor, prediction)
    judged = halves.join(experts.select("KernelId", "expert_score"), "KernelId").where(F.col(prediction).isNotNull())
    return classification_report(judged, "expert_score", prediction)


def binary_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, then precision, recall, F1 and support of both classes, as one row."""
    actual, found = F.col(label).cast("int"), F.col(prediction).cast("int")
    columns = [F.avg((actual == found).cast("double")).alias("accuracy")]
    for c in (0, 1):
        hits, true, said = F.count_if((actual == c) & (found == c)), F.count_if(actual == c), F.count_if(found == c)
        columns += [
            F.coalesce(F.try_divide(hits, said), F.lit(0.0)).alias(f"precision_{c}"),
            F.coalesce(F.try_divide(hits, true), F.lit(0.0)).alias(f"recall_{c}"),
            F.coalesce(F.try_divide(2 * hits, true + said), F.lit(0.0)).alias(f"f1_{c}"),
            true.alias(f"support_{c}"),
        ]
    return df.agg(*columns)


def accuracy_and_recall(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, and recall of class 1."""
    right = F.col(label).cast("int") == F.col(prediction).cast("int")
    actual = F.col(label).cast("int") == 1
    return df.agg(
        F.avg(right.cast("double")).alias("accuracy"),
        F.try_divide(F.count_if(right & actual), F.count_if(actual)).alias("recall"),
    )


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts in ``bins`` equal ranges between the extremes; the last one includes its end."""
    rows = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return rows.select(F.lit(0).alias("bin"), F.col("v").alias("bin_start"), F.lit(0).alias("n"))
    if low == high:
        low, high = low - 0.5, high + 0.5
    index = F.least(F.floor((F.col("v") - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return (
        rows.groupBy(index.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bin", (F.lit(low) + F.col("bin") * (high - low) / bins).alias("bin_start"), "n")
    )


def profile(df: DataFrame) -> DataFrame:
    """Type, rows and missing values of each column, from one pass."""
    types = dict(df.dtypes)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n_{i}") for i, c in enumerate(types)]
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("rows"), F.col(f"n_{i}").alias("nulls"))
            for i, (c, t) in enumerate(types.items())
        ]
    )
    return counts.select(F.inline(entries))


def metrics_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per id and metric."""
    return df.unpivot(list(ids), list(values), "Metric", "Score")
