import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from nbgauge.operators import evaluation


def kappa(spark, rows, **options):
    df = spark.createDataFrame(rows, "`Expert 1` int, `Expert 2` int, `Expert 3` int")
    return evaluation.fleiss_kappa(df, ["Expert 1", "Expert 2", "Expert 3"], **options).first()


def test_kappa(spark):
    assert kappa(spark, [(1, 1, 1), (0, 0, 0), (1, None, 1)]).kappa == pytest.approx(1.0)
    mixed = [(1, 1, 1), (1, 1, 0)]
    assert kappa(spark, mixed).kappa == pytest.approx(23 / 35)
    # Shares 1/6 and 5/6 over all ratings.
    expected = (1 + 25) / 36
    assert kappa(spark, mixed, standard=True).kappa == pytest.approx((2 / 3 - expected) / (1 - expected))


def test_report(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)], "label int, prediction int")
    found = {r["class"]: r for r in evaluation.classification_report(rows).collect()}
    assert (found["0"].precision, found["0"].recall, found["0"].support) == (1.0, 0.5, 2)
    assert (found["1"].precision, found["1"].recall) == (0.5, 1.0)
    assert (found["2"].precision, found["2"].recall, found["2"].f1) == (0.0, 0.0, 0.0)
    assert found["accuracy"].f1 == pytest.approx(0.6) and found["macro avg"].recall == pytest.approx(0.5)
    assert found["weighted avg"].recall == pytest.approx(0.6) and found["weighted avg"].support == 5


def test_auc_hand_case(spark):
    rows = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (3, 1)], "score int, label int")
    assert evaluation.roc_auc(rows).first().roc_auc == pytest.approx(0.875)


def test_auc_equals_evaluator(spark):
    draw = random.Random(1)
    rows = [(float(draw.randint(0, 60)), draw.randint(0, 1)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "score double, label int").repartition(7)
    expected = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df)
    assert evaluation.roc_auc(df).first().roc_auc == pytest.approx(expected)


def test_criterion_report(spark):
    quality = spark.createDataFrame([(i, i * 1.0) for i in range(10)], "KernelId int, topic_score double")
    experts = spark.createDataFrame([(i, int(i >= 5)) for i in range(0, 10, 3)], "KernelId int, expert_score int")
    found = {r["class"]: r for r in evaluation.criterion_report(quality, experts, "topic_score").collect()}
    assert found["accuracy"].f1 == 1.0


def test_histogram_and_profile(spark):
    rows = spark.createDataFrame([(float(i), None if i % 2 else "x") for i in range(11)], "v double, t string")
    counts = {r.bin: r.n for r in evaluation.histogram(rows, "v").collect()}
    assert counts == {**{i: 1 for i in range(9)}, 9: 2}
    assert [r.n for r in evaluation.histogram(rows.where("v = 1"), "v").collect()] == [1]
    assert evaluation.histogram(rows.where("v > 99"), "v").count() == 0
    found = {r.column: (r.rows, r.nulls) for r in evaluation.profile(rows).collect()}
    assert found == {"v": (11, 0), "t": (11, 5)}


def test_long_and_accuracy(spark):
    rows = spark.createDataFrame([("1K", 0.5, 0.25)], "Model string, Accuracy double, Recall double")
    long = evaluation.metrics_to_long(rows, ["Model"], ["Accuracy", "Recall"])
    assert {tuple(r) for r in long.collect()} == {("1K", "Accuracy", 0.5), ("1K", "Recall", 0.25)}
    pairs = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "label int, prediction int")
    assert tuple(evaluation.accuracy_and_recall(pairs).first()) == (0.75, 0.5)
    report = evaluation.binary_report(pairs).first()
    assert (report.accuracy, report.precision_1, report.recall_1, report.f1_1, report.support_1) == (0.75, 1.0, 0.5, pytest.approx(2 / 3), 2)
    assert (report.precision_0, report.recall_0, report.support_0) == (pytest.approx(2 / 3), 1.0, 2)
