"""Notebook metrics of a corpus and of notebook files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from nbgauge import schemas
from nbgauge.operators.notebook import (
    code_notebook_metrics,
    join_author_tier,
    join_notebook_metrics,
    markdown_notebook_metrics,
    mixed_notebook_metrics,
    prepare_author_tier,
)
from nbgauge.plans.cells import mixed_cell_metrics
from nbgauge.sources.notebooks import cells_of, sound_notebooks


def notebook_metrics(
    code_metrics: DataFrame,
    markdown_metrics: DataFrame,
    user_pt: DataFrame | None = None,
    how: str = "left",
    drop_bad_ids: bool = False,
) -> DataFrame:
    """Metrics per notebook from cell metrics, with the author's tier if given."""
    joined = join_notebook_metrics(
        code_notebook_metrics(code_metrics, drop_bad_ids), markdown_notebook_metrics(markdown_metrics, drop_bad_ids), how
    ).select("kernel_id", *schemas.NOTEBOOK_METRICS)
    return joined if user_pt is None else join_author_tier(joined, prepare_author_tier(user_pt))


def metrics_of_notebooks(parsed: DataFrame, popularity: DataFrame, mode: str = "quarantine") -> DataFrame:
    """Metrics per notebook, straight from parsed notebook files.

    Files are read once and cells are combined per notebook before the only
    shuffle.
    """
    cells = cells_of(sound_notebooks(parsed, mode))
    return mixed_notebook_metrics(mixed_cell_metrics(cells, popularity))
