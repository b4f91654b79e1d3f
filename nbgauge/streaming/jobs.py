"""Incremental jobs: cells and notebooks as they land."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nbgauge import schemas
from nbgauge.operators.popularity import api_counts, popularity_from_counts, with_imports
from nbgauge.plans.cells import code_cell_metrics
from nbgauge.plans.notebooks import metrics_of_notebooks
from nbgauge.plans.training import score_notebooks
from nbgauge.session import cut_lineage
from nbgauge.sources.notebooks import notebook_rows, parse_notebooks, rejected_notebooks


def read_cell_stream(
    spark: SparkSession, path: str, schema: str = schemas.CODE_CELLS, files_per_batch: int = 100, glob: str = "*"
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", glob).parquet(path)


#: Cells of a batch that are worth a task of their own.
SPREAD_ROWS = 10_000


def spread(batch: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """The rows of a batch of few large files over all cores."""
    cores = batch.sparkSession.sparkContext.defaultParallelism
    held = batch.rdd.getNumPartitions()
    if held >= cores:
        return batch
    wanted = min(cores, -(-batch.count() // rows))
    return batch.repartition(wanted) if wanted > held else batch


def settled(popularity: DataFrame | None) -> DataFrame | None:
    """The popularity worked out once, however many batches look names up in it."""
    return None if popularity is None else cut_lineage(popularity)


def stream_code_metrics(
    cells: DataFrame, popularity: DataFrame | None, target: str, checkpoint: str
) -> StreamingQuery:
    """Write the metrics of newly landed code cells, a folder per batch; stateless.

    A batch is an ordinary table, so that a popularity of any size can be joined.
    """
    known = settled(popularity)

    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch that is run again writes the same folder again.
        code_cell_metrics(spread(batch), known).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        cells.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def without_repeats(cells: DataFrame, time_col: str, delay: str = "1 day") -> DataFrame:
    """Drop cells delivered again within ``delay``; the state of older ones is let go."""
    return cells.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["kernel_id", "cell_index"])


def stream_api_counts(cells: DataFrame, target: str, checkpoint: str, strict: bool = True) -> StreamingQuery:
    """Running import counts; every batch writes the names whose count changed."""
    counts = api_counts(with_imports(cells.select("source"), strict))

    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch that is run again writes the same folder again.
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_api_counts(spark: SparkSession, target: str) -> DataFrame:
    """Latest count of each name."""
    rows = spark.read.schema("api string, n bigint, batch bigint").parquet(target)
    return rows.groupBy("api").agg(F.max_by("n", "batch").alias("n"))


def current_popularity(spark: SparkSession, target: str, baseline: str = "sklearn") -> DataFrame:
    return popularity_from_counts(current_api_counts(spark, target), baseline)


def read_notebook_stream(
    spark: SparkSession, path: str, files_per_batch: int = 100, glob: str = "*.ipynb"
) -> DataFrame:
    reader = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_batch)
    return notebook_rows(reader.option("pathGlobFilter", glob).text(path))


def stream_notebooks(
    notebooks: DataFrame,
    popularity: DataFrame,
    target: str,
    checkpoint: str,
    model=None,
    pt: int | None = None,
    after_batch: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Metrics, predictions and rejects of newly landed notebooks.

    A notebook is one row, so each batch is complete in itself.  Tables are
    written per batch and written again if the batch is.
    """
    known = settled(popularity)

    def write(batch: DataFrame, batch_id: int) -> None:
        # Read by the metrics and by the rejects.
        parsed = parse_notebooks(batch).persist()
        metrics = metrics_of_notebooks(parsed, known)
        metrics.write.mode("overwrite").parquet(f"{target}/metrics/batch={batch_id}")
        saved = batch.sparkSession.read.parquet(f"{target}/metrics/batch={batch_id}")
        if model is not None:
            predictions = score_notebooks(model, saved, pt)
            predictions.write.mode("overwrite").parquet(f"{target}/predictions/batch={batch_id}")
        rejected_notebooks(parsed).write.mode("overwrite").parquet(f"{target}/rejected/batch={batch_id}")
        parsed.unpersist()
        if after_batch:
            after_batch(saved, batch_id)

    return (
        notebooks.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
