"""Physical plans: what must run once, and what must not shuffle."""

import pytest

from nbgauge import schemas
from nbgauge.operators.cleaning import in_language, with_language
from nbgauge.operators.ordering import select_extremes
from nbgauge.operators.popularity import join_import_score, with_imports
from nbgauge.plans.cells import code_cell_metrics, corpus_popularity
from nbgauge.plans.notebooks import metrics_of_notebooks
from nbgauge.sources import notebooks as nb

IMPORT_MARK = "(?dmU)^"


@pytest.fixture()
def cells(spark, tmp_path):
    rows = [(str(i), 1, f"import sklearn\nx{i} = 1", None, 1) for i in range(20)]
    spark.createDataFrame(rows, schemas.CODE_CELLS).write.parquet(str(tmp_path / "cells"))
    return spark.read.parquet(str(tmp_path / "cells"))


@pytest.fixture()
def plan_of(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_cell_metrics_do_not_shuffle(cells, plan_of):
    plan = plan_of(code_cell_metrics(cells, corpus_popularity(cells)))
    assert "Exchange" not in plan and plan.count(IMPORT_MARK) == 1 and plan.count("ArrowEvalPython") == 1


def test_unused_metrics_are_not_computed(cells, plan_of):
    plan = plan_of(code_cell_metrics(cells).select("kernel_id", "LOC"))
    assert "ArrowEvalPython" not in plan and "regexp" not in plan
    assert "ReadSchema: struct<kernel_id:string,source:string>" in plan


def test_popularity_scans_once(cells, plan_of):
    plan = plan_of(corpus_popularity(cells))
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_joined_scores_match_imports_once_per_scan(cells, plan_of):
    plan = plan_of(join_import_score(with_imports(cells), corpus_popularity(cells)))
    assert plan.count(IMPORT_MARK) == plan.count("FileScan") == 3


def test_notebooks_are_parsed_once_and_shuffled_once(spark, tmp_path, plan_of):
    popularity = spark.createDataFrame([("os", 0.5)], schemas.API_POPULARITY)
    (tmp_path / "a.ipynb").write_text('{"cells": []}')
    parsed = nb.parse_notebooks(nb.read_notebook_files(spark, str(tmp_path)))
    plan = plan_of(metrics_of_notebooks(parsed, popularity))
    assert plan.count("from_json") == 1 and plan.count("Exchange") == 1


def test_detector_runs_once(spark, plan_of):
    rows = spark.createDataFrame([("a",)], "Text string")
    assert plan_of(in_language(with_language(rows, lambda t: t.to_frame().assign(c=0.5)))).count("ArrowEvalPython") == 1


def test_selected_rows_are_not_shuffled(spark, plan_of):
    rows = spark.range(100).selectExpr("id AS KernelId", "id % 7 AS combined_score", "repeat('x', 100) AS wide")
    assert "Exchange" not in plan_of(select_extremes(rows))
