"""Jobs for ``spark-submit`` or ``python -m nbgauge``; paths are those of any Spark file system."""

from __future__ import annotations

import argparse
import json

from nbgauge import schemas
from nbgauge.operators.cleaning import METRICS_FILTERS, SCORES_FILTERS
from nbgauge.operators.learning import CLASSIFIERS
from nbgauge.operators.registry import ModelRegistry
from nbgauge.plans.cells import run_code_metrics, run_markdown_metrics
from nbgauge.plans.notebooks import metrics_of_notebooks, notebook_metrics
from nbgauge.plans.popularity import updated_popularity
from nbgauge.plans.training import score_notebooks, train_job
from nbgauge.session import build_session
from nbgauge.sources import notebooks as nb
from nbgauge.sources import tables


def csv_to_parquet(spark, args):
    kind = {"code": schemas.CODE_CELLS, "markdown": schemas.MARKDOWN_CELLS}[args.kind]
    tables.csv_to_parquet(spark, args.source, args.target, kind, args.files)


def cell_metrics(spark, args):
    if args.kind == "code":
        run_code_metrics(spark, tables.read_code_cells(spark, args.cells), args.popularity, args.target, args.limit)
    else:
        run_markdown_metrics(spark, tables.read_markdown_cells(spark, args.cells), args.target, args.limit)


def aggregate_metrics(spark, args):
    code, markdown = (tables.read_table(spark, p) for p in (args.code_metrics, args.markdown_metrics))
    tiers = tables.read_csv(spark, args.user_pt) if args.user_pt else None
    if tiers is not None:
        tiers = tiers.withColumns({c: tiers[c].try_cast("bigint") for c in ("Id_x", "PerformanceTier")})
    tables.write_table(notebook_metrics(code, markdown, tiers, drop_bad_ids=args.drop_bad_ids), args.target)


def train_model(spark, args):
    key, reports = train_job(
        tables.read_table(spark, args.metrics),
        tables.read_table(spark, args.scores),
        ModelRegistry(spark, args.registry),
        args.name,
        args.classifier,
        experts=tables.read_csv(spark, args.experts) if args.experts else None,
        metrics_filters=args.metrics_filter or args.metrics_filters_key,
        scores_filters=args.scores_filter or args.scores_filters_key,
        sort_by=args.selected_score,
        split_factor=args.split_factor,
        selection_ratio=args.selection_ratio,
        include_pt=args.include_pt,
    )
    print(json.dumps({"model_id": key, "metrics": reports}, indent=2))


def file_metrics(spark, args):
    popularity = updated_popularity(spark, tables.read_code_cells(spark, args.cells), args.popularity)
    return metrics_of_notebooks(nb.parse_notebooks(nb.read_notebook_files(spark, args.notebooks)), popularity)


def extract_notebook_metrics(spark, args):
    write = {"csv": tables.write_metrics_csv, "json": tables.write_metrics_json, "parquet": tables.write_table}
    write[args.format](file_metrics(spark, args), args.target)


def predict(spark, args):
    model = ModelRegistry(spark, args.registry).load(args.model_id)
    if model is None:
        raise SystemExit(f"no model {args.model_id}")
    tables.write_table(score_notebooks(model, file_metrics(spark, args), args.pt_score), args.target)


def list_models(spark, args):
    for row in ModelRegistry(spark, args.registry).models(args.classifier).collect():
        print(row["model_id"], row["info"])


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="nbgauge", description=__doc__)
    commands = root.add_subparsers(required=True)

    def command(function, *positional: str, **options):
        sub = commands.add_parser(function.__name__.replace("_", "-"))
        sub.set_defaults(run=function)
        for name in positional:
            sub.add_argument(name)
        for name, settings in options.items():
            sub.add_argument("--" + name.replace("_", "-"), **settings)

    kind = dict(choices=["code", "markdown"], default="code")
    share = dict(type=float)
    command(csv_to_parquet, "source", "target", kind=kind, files=dict(type=int))
    command(cell_metrics, "cells", "target", kind=kind, popularity={}, limit=dict(type=int, default=0))
    command(aggregate_metrics, "code_metrics", "markdown_metrics", "target", user_pt={}, drop_bad_ids=dict(action="store_true"))
    command(
        train_model, "metrics", "scores", "registry", "name",
        classifier=dict(choices=list(CLASSIFIERS), default="cat_boost"),
        experts={},
        selected_score=dict(default="combined_score"),
        split_factor=dict(share, default=0.7),
        selection_ratio=dict(share, default=0.25),
        metrics_filters_key=dict(choices=list(METRICS_FILTERS), default="default"),
        scores_filters_key=dict(choices=list(SCORES_FILTERS), default="default"),
        metrics_filter=dict(action="append"),
        scores_filter=dict(action="append"),
        include_pt=dict(action="store_true"),
    )
    formats = dict(choices=["csv", "json", "parquet"], default="parquet")
    command(extract_notebook_metrics, "notebooks", "cells", "popularity", "target", format=formats)
    command(predict, "notebooks", "cells", "popularity", "registry", "model_id", "target", pt_score=dict(type=int))
    command(list_models, "registry", classifier=dict(choices=list(CLASSIFIERS)))
    return root


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    args.run(build_session(), args)


if __name__ == "__main__":
    main()
