"""Headline queries, timed: prints one JSON line.

The cell tables are inputs of the library, so both kinds of cells are written
once before the clock starts; every timed query then reads Parquet and runs to
its last row.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from nbgauge.operators.cleaning import clean_comments
from nbgauge.operators.evaluation import roc_auc
from nbgauge.operators.ordering import select_extremes, with_global_rank
from nbgauge.operators.popularity import with_imports, join_import_score
from nbgauge.plans.cells import code_cell_metrics, corpus_popularity, markdown_cell_metrics
from nbgauge.plans.notebooks import notebook_metrics
from nbgauge.plans.quality import kernel_facts, kernel_quality
from nbgauge.session import build_session
from workloads.views import view


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="bench-")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": folder,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    view(spark, sf_dir, "code_cells").repartition(int(cpus)).write.parquet(f"{folder}/code_cells")
    view(spark, sf_dir, "text_cells").repartition(int(cpus)).write.parquet(f"{folder}/text_cells")
    cells, texts = spark.read.parquet(f"{folder}/code_cells"), spark.read.parquet(f"{folder}/text_cells")
    code_cell_metrics(cells, corpus_popularity(cells)).write.parquet(f"{folder}/code_metrics")
    metrics = spark.read.parquet(f"{folder}/code_metrics")
    markdown = markdown_cell_metrics(view(spark, sf_dir, "markdown_cells"))
    kernels, users, comments = (view(spark, sf_dir, n) for n in ("kernels", "users", "comments"))
    scored = cells.select("kernel_id", F.length("source").alias("score"), (F.col("cell_index") % 2).alias("label"))

    queries = {
        "api_popularity": lambda: corpus_popularity(cells),
        "code_cell_metrics": lambda: code_cell_metrics(cells, corpus_popularity(cells)),
        "code_cell_metrics_without_parser": lambda: code_cell_metrics(cells).drop("CyC"),
        "cell_import_score_joined": lambda: join_import_score(with_imports(cells), corpus_popularity(cells)).select("EAP"),
        "text_cell_metrics": lambda: code_cell_metrics(texts),
        "notebook_metrics_from_cells": lambda: notebook_metrics(code_cell_metrics(cells, corpus_popularity(cells)), markdown),
        "notebook_metrics": lambda: notebook_metrics(metrics, markdown),
        "comments_cleaned": lambda: clean_comments(comments),
        "kernel_quality": lambda: kernel_quality(comments, kernel_facts(cells, kernels, users)),
        "select_extremes": lambda: select_extremes(kernels, "TotalVotes", id_col="Id"),
        "global_rank": lambda: with_global_rank(kernels, "TotalVotes", "Id"),
        "roc_auc": lambda: roc_auc(scored),
    }
    seconds = {}
    for name, run in queries.items():
        # Better of two runs: the first one also compiles the generated code.
        for _ in range(2):
            start = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            seconds[name] = min(round(time.perf_counter() - start, 3), seconds.get(name, float("inf")))
    rows = cells.count()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
                "code_cells": rows,
                "code_cells_per_sec": round(rows / seconds["code_cell_metrics"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
