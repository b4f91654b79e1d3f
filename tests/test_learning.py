import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nbgauge import schemas
from nbgauge.operators import forest, importance, learning, subwords, textmodel
from nbgauge.operators.registry import ModelRegistry, model_id
from nbgauge.plans import training


@pytest.fixture(scope="module")
def tables(spark):
    """Notebooks whose score follows LOC; the other metrics are noise."""
    draw = random.Random(3)
    names = [n for n in schemas.NOTEBOOK_METRICS if n != "LOC"]
    rows = [(i, i % 900 * 1.0, *[draw.random() for _ in names]) for i in range(600)]
    features = spark.createDataFrame(rows, f"kernel_id bigint, LOC double, {', '.join(f'{n} double' for n in names)}").withColumn("PT", F.lit(1))
    scores = features.select(
        F.col("kernel_id").alias("KernelId"), F.lit(1000).cast("bigint").alias("TotalViews"), F.lit(1).cast("bigint").alias("TotalVotes"),
        F.lit(1).alias("PerformanceTier_kerneluser"), F.lit(0.1).alias("topic_score"), F.lit(0.1).alias("score_scaled"),
        F.lit(0.1).alias("vote_scaled"), F.col("LOC").cast("double").alias("combined_score"),
    )
    experts = features.select(F.col("kernel_id").alias("KernelId"), (F.col("LOC") > 400).cast("int").alias("expert_score"))
    return features, scores, experts


def test_training_set(tables):
    features, scores, _ = tables
    rows = training.training_set(features, scores, ["LOC < 1000"], ["TotalViews >= 500"], include_pt=False)
    assert "ALLCL" in rows.columns and "PT" not in rows.columns and "KernelId" not in rows.columns
    counts = {(r.label, r.split): r.n for r in rows.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    low, high = int(0.25 * 0.7 * 600), int(0.25 * (1 - 0.7) * 600)
    assert sum(n for (label, _), n in counts.items() if label == 0) == low
    assert sum(n for (label, _), n in counts.items() if label == 1) == high
    assert sum(n for (_, split), n in counts.items() if split == "test") == -(-(low + high) // 10)


def test_job_registry_and_scoring(spark, tables, tmp_path):
    features, scores, experts = tables
    registry = ModelRegistry(spark, str(tmp_path / "registry"))
    assert registry.models().count() == 0
    key, reports = training.train_job(features, scores, registry, "tree", "decision_tree", experts=experts)
    assert reports["default"]["roc_auc_score"] > 0.9 and reports["experts"]["accuracy"]["f1"] > 0.6
    assert registry.models("decision_tree").count() == 1 and registry.models("xg_boost").count() == 0
    info = registry.info(key)
    assert info["metrics"]["default"]["accuracy"]["support"] > 0 and model_id({**info, "metrics": None}) == key
    model = registry.load(key)
    notebooks = features.drop("PT")
    first = training.score_notebooks(model, notebooks).orderBy("kernel_id").collect()
    assert len(first) == 600 and first == training.score_notebooks(registry.load(key), notebooks).orderBy("kernel_id").collect()
    assert registry.load("unknown") is None


def test_tier_is_asked_for(spark, tables, tmp_path):
    features, scores, _ = tables
    rows = training.training_set(features, scores)
    model = learning.train(rows, learning.decision_tree())
    with pytest.raises(ValueError, match="PT"):
        training.score_notebooks(model, features.drop("PT"))
    assert training.score_notebooks(model, features.drop("PT"), pt=3).count() == 600


def test_forest_search_and_importance(tables):
    features, scores, _ = tables
    rows = training.training_set(features, scores, include_pt=False).select("LOC", "ID", "CW", "label", "split")
    model = learning.train(rows, learning.random_forest(candidates=2, folds=2, trees=5))
    bigger = learning.refit_best(model, rows, trees=7)
    assert bigger.n_trees == 7 and len(model.info["accuracy"]) == 2 and max(model.info["accuracy"]) > 0.9
    found = {r.feature: r.importance for r in importance.permutation_importance(bigger, rows).collect()}
    assert set(found) == {"LOC", "ID", "CW"} and found["LOC"] > 0.1 > abs(found["CW"])
    ranked = importance.model_importance(bigger, rows).orderBy(F.desc("importance")).first()
    assert ranked.feature == "LOC"


def test_presets():
    shapes = forest.candidates()
    assert len(shapes) == 10 and shapes == forest.candidates()
    assert len({(s.depth, s.least_split, s.least_leaf) for s in forest.candidates(396)}) == 99
    assert any(s.depth is None for s in forest.candidates(396)) and max(s.depth or 0 for s in shapes) > 30
    with pytest.raises(ValueError):
        learning.classifier("svm")


def test_text_models(spark):
    rows = [(i, ("buy cheap offer now " if i % 2 else "how does this loop work ") + str(i), i % 2) for i in range(200)]
    sheet = spark.createDataFrame(rows, "Id int, Text string, label int")
    model, report = textmodel.train_topic_model(sheet, buckets=1 << 10)
    assert {r["class"]: r.f1 for r in report.collect()}["accuracy"] > 0.9
    no_ads, kept = textmodel.filter_comments(sheet.drop("label"), model, model)
    assert no_ads.count() == 100 and kept.count() == 100
    texts = sheet.select(F.col("Id").alias("KernelId"), F.col("Text").alias("code"), F.lit(None).cast("string").alias("markdown"), "label")
    curve = textmodel.learning_curve(texts, texts, sizes=(60, 120), buckets=1 << 10).collect()
    assert [(r["size"], r.test_set) for r in curve] == [(60, "test"), (60, "experts"), (120, "test"), (120, "experts")]
    assert curve[-1].accuracy > 0.9 and curve[-1].f1_1 > 0.9


def test_bags_of_subwords():
    ids, weights = subwords.bag("Loop loop", 1 << 16)
    assert sorted(ids) == list(ids) and len(ids) == 10 and np.allclose(weights, math.log(3) / math.sqrt(10))
    for empty in (None, "", " \n…"):
        assert len(subwords.bag(empty, 64)[0]) == 0
    # One word of a million letters: no more buckets than there are.
    ids, _ = subwords.bag("ab" * 500_000, 64)
    assert len(ids) <= 64


def bag_by_definition(text, buckets):
    """Word after word, run after run."""
    found = {}
    words = re.findall(r"\w+", (text or "").lower())
    for word in dict.fromkeys(words):
        marked = f"<{word}>"
        runs = {marked, *(marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1))}
        ids = {zlib.crc32(r.encode("utf-8", "surrogatepass")) % buckets for r in runs}
        for i in ids:
            found[i] = found.get(i, 0.0) + math.log1p(words.count(word)) / math.sqrt(len(ids))
    return found


def test_bags_of_many_texts(monkeypatch):
    """Texts are cut together; each gets the bag it has alone."""
    texts = ["one two two three", None, "", "a b ab <a>", "Straße ÉTÉ naïve 日本語 😀 été", "\ud800x y\udfff", "İstanbul ﬁ _ __ 22"]
    texts += [f"{'x' * n} {'é' * n} loop{n}" for n in range(1, 50)] + ["", "ab" * 2000, " "]
    for chars in (subwords.CHARS, 40):
        monkeypatch.setattr(subwords, "CHARS", chars)
        for buckets in (7, 1 << 16, 1 << 20):
            found = list(subwords.bags(texts, buckets))
            assert len(found) == len(texts)
            for text, (ids, weights) in zip(texts, found):
                known = bag_by_definition(text, buckets)
                assert ids.tolist() == sorted(known) and np.allclose(weights, [known[i] for i in sorted(known)]), (text, buckets)
                alone = subwords.bag(text, buckets)
                assert (alone[0] == ids).all() and (alone[1] == weights).all()


def test_subword_bags_are_short_and_written_once(spark, monkeypatch):
    """A round reads a few bytes per subword, and many texts in a row."""
    draw = random.Random(3)
    rows = [(" ".join(f"word{draw.randrange(3000)}" for _ in range(120)), i % 2) for i in range(300)]
    sheet = spark.createDataFrame(rows, "text string, label int").coalesce(2)
    tables, written = [], subwords._written
    monkeypatch.setattr(subwords, "_written", lambda df: tables.append(written(df)) or tables[-1])
    subwords.SubwordLearner(buckets=1 << 16, size=2, rounds=2).fit(sheet)
    assert len(tables) == 1
    (bags,) = tables
    columns = [c for c, kind in bags.dtypes if kind == "binary"]
    size = sum(len(value) for row in bags.select(*columns).collect() for value in row)
    subwords_of_all = sum(len(subwords.bag(text, 1 << 16)[0]) for text, _ in rows)
    assert size < 6 * subwords_of_all and bags.count() < len(rows) / 10


def by_hand(bags, labels, learner):
    """The same training on dense matrices."""
    x = np.zeros((len(bags), learner.buckets))
    for i, (ids, weights) in enumerate(bags):
        x[i, ids] = weights
    x *= np.log((1 + len(bags)) / (1 + (x > 0).sum(axis=0)))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    draw = np.random.default_rng(learner.seed)
    vectors, head, bias = draw.normal(0, 0.1, (learner.buckets, learner.size)), draw.normal(0, learner.size**-0.5, learner.size), 0.0
    share = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    moved = [0.0, 0.0, 0.0]
    for _ in range(learner.rounds):
        mean = x @ vectors
        residual = (1 / (1 + np.exp(-(mean @ head + bias))) - labels) * share
        slopes = [learner.step * x.T @ np.outer(residual, head), learner.head_step * mean.T @ residual, learner.head_step * learner.step * residual.sum()]
        moved = [learner.momentum * m - s for m, s in zip(moved, slopes)]
        vectors, head, bias = vectors + moved[0], head + moved[1], bias + moved[2]
    return vectors, head, bias


def test_subword_training(spark, tmp_path):
    texts = [("offers cheaply " if i % 3 else "loops iterate ") + f"w{i * 7919 % 100}" for i in range(120)]
    rows = [(i, t, int(i % 3 > 0)) for i, t in enumerate(texts)]
    rows += [(200, None, 0), (201, "", 1), (202, "unlabelled", None)]
    sheet = spark.createDataFrame(rows, "Id int, Text string, label int")
    learner = subwords.SubwordLearner(buckets=256, size=4, rounds=12)
    model = learner.fit(sheet, "Text")
    known = [(subwords.bag(t, 256), label) for _, t, label in rows if label is not None]
    vectors, head, bias = by_hand([b for b, _ in known], np.array([y for _, y in known]), learner)
    assert np.allclose(model.vectors, vectors, atol=1e-8) and np.allclose(model.head, head, atol=1e-8) and abs(model.bias - bias) < 1e-8
    # Other partitions, the same weights to the last bit.
    again = learner.fit(sheet.repartition(7), "Text")
    assert (again.vectors == model.vectors).all() and (again.head == model.head).all() and again.bias == model.bias
    registry = ModelRegistry(spark, str(tmp_path))
    loaded = registry.load(registry.save(model, "texts", "subwords"))
    scored = textmodel.predict_text(loaded, sheet, "Text").collect()
    assert all(r.prediction == r.label for r in scored if r.Id < 200) and len(scored) == 123
    unseen = spark.createDataFrame([(1, "cheapest offering", 0), (2, None, 0)], "Id int, Text string, prediction int").drop("prediction")
    found = {r.Id: r for r in loaded.embed(loaded.transform(unseen)).collect()}
    assert found[1].prediction == 1 and len(found[1].vector) == 4 and found[2].vector == [0.0] * 4
    assert abs(found[2].score - 1 / (1 + math.exp(-model.bias))) < 1e-9


def test_subwords_of_one_class(spark):
    rows = spark.createDataFrame([("a b", 1), ("c", 1)], "text string, label int")
    learner = subwords.SubwordLearner(buckets=64, size=2, rounds=2)
    assert {r.prediction for r in learner.fit(rows).transform(rows).collect()} == {1.0}
    assert learner.fit(rows.limit(0)).transform(rows).count() == 2
    with pytest.raises(ValueError):
        learner.fit(rows.withColumn("label", F.lit(3)))


def test_subwords_beat_word_counts(spark):
    """Texts told by beginnings of words that the test part has in other forms."""
    draw = random.Random(5)
    forms = [f"{e}{f}" for e in ("ing", "ed", "er", "s", "able") for f in ("", "ly", "ness")]
    rows = []
    for i in range(400):
        ends = forms[:8] if i < 300 else forms[8:]
        stem = ("insult", "mock")[i % 4 // 2] if i % 2 else ("explain", "plott")[i % 4 // 2]
        rows.append((i, " ".join([f"w{draw.randrange(300)}" for _ in range(12)] + [stem + draw.choice(ends)]), i % 2))
    sheet = spark.createDataFrame(rows, "Id int, Text string, label int")
    train, test = sheet.where("Id < 300"), sheet.where("Id >= 300")

    def right(model):
        return textmodel.predict_text(model, test, "Text").where("prediction = label").count()

    learned, counted = right(subwords.train_subword_model(train, "Text")), right(textmodel.train_text_model(train, "Text"))
    assert learned >= counted + 15, (learned, counted)


def test_batch_scoring_works_out_the_features_once(spark, monkeypatch):
    from workloads import learning as queries

    calls, features = [], queries.features
    monkeypatch.setattr(queries, "features", lambda *a: calls.append(a) or features(*a))
    scored = queries.batch_scoring(spark, "/root/testdata/sf0.001")
    assert scored.count() == features(spark, "/root/testdata/sf0.001").count() and len(calls) == 1
