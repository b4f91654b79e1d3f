"""Queries that train and apply models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nbgauge.operators import attribution, forest, importance, learning, textmodel
from nbgauge.operators.cleaning import topic_label
from nbgauge.operators.ordering import class_counts
from nbgauge.operators.registry import ModelRegistry, model_id
from nbgauge.operators.subwords import train_subword_model
from nbgauge.operators.texts import assemble_texts
from nbgauge.plans import study, training
from workloads import sql
from workloads.cells import work_dir
from workloads.notebooks import all_notebook_metrics, mixed_cells
from workloads.registry import collection
from workloads.scores import kernel_quality
from workloads.views import source_table, view

QUERIES, ORACLES, query = collection()


def features(spark, sf_dir, *columns) -> DataFrame:
    """Notebook metrics with the author's tier, written once per query: all, or those that a query reads."""
    tiers = view(spark, sf_dir, "users").select(F.col("Id").alias("Id_x"), "PerformanceTier")
    target = f"{work_dir(spark)}/features"
    all_notebook_metrics(spark, sf_dir, tiers).select(*(columns or "*")).write.parquet(target)
    return spark.read.parquet(target)


def scores(spark, sf_dir) -> DataFrame:
    target = f"{work_dir(spark)}/scores"
    kernel_quality(spark, sf_dir).write.parquet(target)
    return spark.read.parquet(target)


def training_rows(spark, sf_dir, table: DataFrame | None = None, **options) -> DataFrame:
    """The training set; ``table`` holds the features if a query has written them already."""
    filters = dict(metrics_filters=["LOC < 1000"], scores_filters=["TotalViews >= 500"])
    return training.training_set(features(spark, sf_dir) if table is None else table, scores(spark, sf_dir), **filters, **options)


JOINED = (
    *sql.NOTEBOOK_METRICS,
    *[part for part in sql.QUALITY],
    (
        "joined",
        "SELECT q.KernelId, q.combined_score, n.LOC, n.ID FROM quality q JOIN notebooks n ON q.KernelId = n.kernel_id "
        "WHERE n.LOC < 1000 AND q.TotalViews >= 500",
    ),
)


@query(sql.cte(*JOINED) + "SELECT KernelId, CAST(LOC AS BIGINT) AS LOC, CAST(ID AS BIGINT) AS ID, round(combined_score, 6) AS combined_score FROM joined")
def scored_features(spark, sf_dir):
    rows = training.scored_features(features(spark, sf_dir), scores(spark, sf_dir), ["LOC < 1000"], ["TotalViews >= 500"])
    return rows.select("KernelId", F.col("LOC").cast("bigint").alias("LOC"), F.col("ID").cast("bigint").alias("ID"), F.round("combined_score", 6).alias("combined_score"))


@query(
    sql.cte(
        *JOINED,
        ("e", "SELECT CAST(floor(0.25::DOUBLE * 0.7::DOUBLE * count(*)) AS BIGINT) AS a, CAST(floor(0.25::DOUBLE * (1 - 0.7::DOUBLE) * count(*)) AS BIGINT) AS b FROM joined"),
    )
    + "SELECT CAST(0 AS BIGINT) AS label, a AS n FROM e UNION ALL SELECT 1, b FROM e"
)
def training_set_sizes(spark, sf_dir):
    rows = training_rows(spark, sf_dir).withColumn("label", F.col("label").cast("bigint"))
    return class_counts(rows, "label")


@query(
    sql.cte(
        *sql.NOTEBOOK_METRICS,
        sql.view("expert_scores"),
        ("judged", "SELECT e.KernelId, e.expert_score, n.LOC, n.ID FROM expert_scores e JOIN notebooks n ON e.KernelId = n.kernel_id WHERE n.LOC < 1000"),
    )
    + "SELECT CAST(expert_score AS BIGINT) AS label, CAST(LOC AS BIGINT) AS LOC, CAST(ID AS BIGINT) AS ID FROM (SELECT *, row_number() OVER (PARTITION BY expert_score ORDER BY KernelId) AS r FROM judged) "
    "WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM judged GROUP BY expert_score))"
)
def expert_test_set(spark, sf_dir):
    rows = training.expert_test_set(features(spark, sf_dir), view(spark, sf_dir, "expert_scores"), ["LOC < 1000"], False)
    return rows.select(*[F.col(c).cast("bigint").alias(c) for c in ("label", "LOC", "ID")])


def _train_query(name: str, classifier: str, **params) -> None:
    def run(spark, sf_dir):
        rows = training_rows(spark, sf_dir, include_pt=False)
        model = learning.train(rows.where("split = 'train'"), learning.classifier(classifier, **params))
        return learning.predict(model, rows.where("split = 'test'")).select("label", "prediction", "score")

    run.__name__ = name
    query()(run)


_train_query("train_boosted_trees", "cat_boost")
_train_query("train_boosted_trees_deep", "xg_boost")
_train_query("train_decision_tree", "decision_tree")
_train_query("train_decision_tree_unbounded", "decision_tree_unbounded")
_train_query("train_random_forest", "random_forest")


@query("SELECT 'tree' AS file_name, 'decision_tree' AS classifier, true AS same_id, CAST(5 AS INT) AS features")
def train_and_register(spark, sf_dir):
    """A whole training job; the registry rows it leaves, and whether their ids are those of what they say."""
    registry = ModelRegistry(spark, work_dir(spark))
    training.train_job(
        features(spark, sf_dir), scores(spark, sf_dir), registry, "tree", "decision_tree",
        experts=view(spark, sf_dir, "expert_scores"), metrics=["LOC", "ID", "OPRND", "CW", "MC"],
    )
    ((key, info),) = [(r["model_id"], registry.info(r["model_id"])) for r in registry.models("decision_tree").collect()]
    return registry.models("decision_tree").select(
        "file_name", "classifier", F.lit(model_id(info) == key).alias("same_id"),
        F.size(F.from_json(F.get_json_object("info", "$.features"), "array<string>")).alias("features"),
    )


@query()
def batch_scoring(spark, sf_dir):
    """All notebooks scored by a model trained on the best and the worst."""
    table = features(spark, sf_dir)
    rows = training_rows(spark, sf_dir, table)
    model = learning.train(rows.where("split = 'train'"), learning.decision_tree())
    return training.score_notebooks(model, table.drop("PT"), pt=2)


@query()
def permutation_importance(spark, sf_dir):
    rows = training_rows(spark, sf_dir, include_pt=False)
    names = ["LOC", "ID", "OPRND", "CW", "MC"]
    model = learning.train(rows.where("split = 'train'"), learning.decision_tree(maxDepth=5), names)
    return importance.permutation_importance(model, rows.where("split = 'test'"))


@query()
def model_importance(spark, sf_dir):
    rows = training_rows(spark, sf_dir, include_pt=False)
    model = learning.train(rows.where("split = 'train'"), learning.decision_tree(maxDepth=5))
    return importance.model_importance(model, rows)


@query()
def comment_topic_model(spark, sf_dir):
    """Labelled texts to a model, the model to a filter over all texts."""
    texts = source_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("Id"), F.col("text").alias("Text"))
    sheet = texts.join(source_table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "Id"), "Id")
    model, _ = textmodel.train_topic_model(topic_label(sheet, "toxic"))
    return textmodel.keep_class(model, texts, wanted=0).select("Id")


@query()
def comment_topic_model_subwords(spark, sf_dir):
    """The same with learned subword vectors."""
    texts = source_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("Id"), F.col("text").alias("Text"))
    sheet = texts.join(source_table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "Id"), "Id")
    model, _ = textmodel.train_topic_model(topic_label(sheet, "toxic"), train=train_subword_model)
    return textmodel.keep_class(model, texts, wanted=0).select("Id")


def labelled_notebooks(spark, sf_dir) -> DataFrame:
    texts = assemble_texts(mixed_cells(spark, sf_dir))
    return texts.select(F.col("kernel_id").alias("KernelId"), "code", "markdown", (F.length("code") > F.length("markdown")).cast("int").alias("label"))


@query()
def notebook_text_curve(spark, sf_dir):
    return textmodel.learning_curve(labelled_notebooks(spark, sf_dir))


@query()
def notebook_text_curve_subwords(spark, sf_dir):
    return textmodel.learning_curve(labelled_notebooks(spark, sf_dir), train=train_subword_model)


@query("SELECT p_partkey, CAST(p_type = 'ECONOMY' AS INT) AS prediction FROM part")
def separable_subword_texts(spark, sf_dir):
    """Texts whose last word decides; the model goes through the registry."""
    text = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    rows = source_table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), (F.col("p_type") == "ECONOMY").cast("int").alias("label"))
    registry = ModelRegistry(spark, work_dir(spark))
    key = registry.save(train_subword_model(rows), "texts", "subwords")
    return textmodel.predict_text(registry.load(key), rows).select("p_partkey", "prediction")


@query()
def quality_study(spark, sf_dir):
    """Comments to scored notebooks in one job; the reports against the experts."""
    sheet = source_table(spark, sf_dir, "documents").join(source_table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("Id"), F.col("text").alias("Text"), F.col("toxic").alias("advertise"),
        F.col("quality").alias("comperenension"),
    )
    tables = study.run_study(
        spark, work_dir(spark), view(spark, sf_dir, "comments"), sheet, view(spark, sf_dir, "code_cells").select("kernel_id"),
        view(spark, sf_dir, "kernels"), view(spark, sf_dir, "users"), view(spark, sf_dir, "expert_scores"),
    )
    return tables["reports"]


# -- models whose answers are known --------------------------------------------

# A notebook is long if it has four cells or more; the number of cells tells it, whatever the data.
LONG = sql.cte(*sql.NOTEBOOK_METRICS) + "SELECT kernel_id, CAST(CC AS BIGINT) AS CC, CAST(CC >= 4 AS INT) AS prediction FROM notebooks"


def long_notebooks(spark, sf_dir) -> DataFrame:
    rows = features(spark, sf_dir, "kernel_id", "CC", "H1")
    return rows.select("kernel_id", "CC", "H1", (F.col("CC") >= 4).cast("int").alias("label"))


def _separable_query(name: str, classifier: str, **params) -> None:
    def run(spark, sf_dir):
        rows = long_notebooks(spark, sf_dir)
        model = learning.train(rows, learning.classifier(classifier, **params), ["CC"])
        return learning.predict(model, rows).select("kernel_id", F.col("CC").cast("bigint").alias("CC"), "prediction")

    run.__name__ = name
    query(LONG)(run)


_separable_query("separable_decision_tree", "decision_tree")
_separable_query("separable_decision_tree_unbounded", "decision_tree_unbounded")
_separable_query("separable_boosted_trees", "cat_boost")
_separable_query("separable_boosted_trees_deep", "xg_boost")
_separable_query("separable_random_forest", "random_forest")


@query(LONG)
def separable_refitted_forest(spark, sf_dir):
    """The 500 trees that are grown after a search, in the shape it found."""
    rows = long_notebooks(spark, sf_dir)
    model = learning.train(rows, forest.Forest(trees=10), ["CC"])
    return learning.predict(learning.refit_best(model, rows), rows).select("kernel_id", F.col("CC").cast("bigint").alias("CC"), "prediction")


def two_level_notebooks(spark, sf_dir) -> DataFrame:
    """A label that takes two questions: many cells, or few cells and long ones.  The second metric is missing where the first decides."""
    rows = features(spark, sf_dir, "kernel_id", "CC", "LOC")
    many = F.col("CC") >= 4
    return rows.select(
        "kernel_id", "CC", F.when(~many, F.col("LOC") / F.col("CC")).alias("mean_lines"),
        (many | (F.col("LOC") / F.col("CC") >= 4.5)).cast("int").alias("label"),
    )


TWO_LEVELS = (
    sql.cte(*sql.NOTEBOOK_METRICS) + "SELECT kernel_id, CAST(CC AS BIGINT) AS CC, CAST(CC >= 4 OR LOC / CC::DOUBLE >= 4.5 AS INT) AS prediction FROM notebooks"
)


def _two_level_query(name: str, classifier: str, **params) -> None:
    def run(spark, sf_dir):
        rows = two_level_notebooks(spark, sf_dir)
        model = learning.train(rows, learning.classifier(classifier, **params), ["CC", "mean_lines"])
        return learning.predict(model, rows).select("kernel_id", F.col("CC").cast("bigint").alias("CC"), "prediction")

    run.__name__ = name
    query(TWO_LEVELS)(run)


_two_level_query("two_level_boosted_trees", "cat_boost")
_two_level_query("two_level_boosted_trees_deep", "xg_boost")
_two_level_query("two_level_decision_tree", "decision_tree_unbounded")


@query(sql.cte(*sql.NOTEBOOK_METRICS) + "SELECT 0 AS level, 'CC' AS feature, max(CC)::DOUBLE AS wall, true AS missing_left FROM notebooks WHERE CC < 4")
def separable_first_split(spark, sf_dir):
    """The wall all trees of the symmetric learner ask for first, and on which side missing values go."""
    rows = long_notebooks(spark, sf_dir)
    model = learning.train(rows, learning.boosted_trees_slow(), ["CC", "H1"])
    roots = model.nodes.where("path = ''").select("feature", "wall", "missing_left").distinct()
    name = F.get(F.array(*[F.lit(c) for c in model.features]), "feature")
    return roots.select(F.lit(0).alias("level"), name.alias("feature"), "wall", "missing_left")


@query(
    sql.cte(*sql.NOTEBOOK_METRICS)
    + "SELECT kernel_id, true AS adds_up, CAST(CASE WHEN CC >= 4 THEN 1 ELSE -1 END AS INT) AS towards, true AS unused_is_zero FROM notebooks"
)
def separable_attributions(spark, sf_dir):
    """Shapley values of every notebook: with the mean they are the margin, the number of cells decides, the other metric adds nothing."""
    rows = long_notebooks(spark, sf_dir)
    model = learning.train(rows, learning.boosted_trees_deep(), ["CC", "H1"])
    found = attribution.attributions(model, model.with_margin(rows))
    parts = F.col("attributions")
    return found.select(
        "kernel_id", (F.abs(F.col("base") + parts[0] + parts[1] - F.col("margin")) < 1e-6).alias("adds_up"),
        F.signum(parts[0]).cast("int").alias("towards"), (parts[1] == 0).alias("unused_is_zero"),
    )


@query()
def mean_attributions(spark, sf_dir):
    """Direction and size of each metric's part in the scores of the test set."""
    rows = training_rows(spark, sf_dir, include_pt=False)
    model = learning.train(rows.where("split = 'train'"), learning.boosted_trees_deep())
    return attribution.mean_attributions(model, rows.where("split = 'test'"))


@query(LONG)
def registered_model_predicts(spark, sf_dir):
    """Saved, found by its id, loaded and applied to all notebooks."""
    rows = long_notebooks(spark, sf_dir)
    registry = ModelRegistry(spark, work_dir(spark))
    key = registry.save(learning.train(rows, learning.boosted_trees_quick(), ["CC"]), "tree", "cat_boost")
    scored = training.score_notebooks(registry.load(key), rows).select("kernel_id", "prediction")
    return rows.join(scored, "kernel_id").select("kernel_id", F.col("CC").cast("bigint").alias("CC"), "prediction")


@query("SELECT unnest(['CC', 'H1']) AS feature, unnest([1.0::DOUBLE, 0.0::DOUBLE]) AS importance")
def separable_importance(spark, sf_dir):
    """All weight on the number of cells."""
    rows = long_notebooks(spark, sf_dir)
    model = learning.train(rows, learning.decision_tree(maxDepth=1), ["CC", "H1"])
    return importance.model_importance(model, rows)


@query("SELECT 'H1' AS feature, 1.0::DOUBLE AS accuracy, 0.0::DOUBLE AS importance")
def unused_feature_importance(spark, sf_dir):
    """Shuffling a feature that the tree does not ask for loses nothing."""
    rows = long_notebooks(spark, sf_dir)
    model = learning.train(rows, learning.decision_tree(maxDepth=1), ["CC", "H1"])
    return importance.permutation_importance(model, rows, features=["H1"])
