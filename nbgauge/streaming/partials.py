"""Notebook metrics of a stream of cells, where a notebook arrives over many batches.

Each batch leaves sums, counts and maxima per notebook, which can be added to those of
any other batch.  Once a generation has ``FANOUT`` tables, they are added up into one of
the next generation, so a reader meets few tables however many batches there were.
Tables are named by the batches they cover: what a larger table covers is not read any
more, whether or not it was deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nbgauge import schemas
from nbgauge.operators.notebook import finished_code_metrics
from nbgauge.plans.cells import code_cell_metrics
from nbgauge.streaming.jobs import settled, spread

#: Tables of a generation before they are added up.
FANOUT = 8

_SUMS = tuple(dict.fromkeys((*schemas.CODE_SUMS, *schemas.CODE_MEANS)))


def code_partials(cell_metrics: DataFrame) -> DataFrame:
    """Sums, counts and maxima of the code cells of each notebook."""
    rows = cell_metrics.where(F.col("kernel_id").isNotNull())
    return rows.groupBy("kernel_id").agg(
        *[F.sum(m).alias(f"sum_{m}") for m in _SUMS], *[F.count(m).alias(f"n_{m}") for m in schemas.CODE_MEANS],
        *[F.max(m).alias(f"max_{m}") for m in schemas.CODE_MAXIMA], F.count("LOC").alias("n_cells"),
    )


def added_partials(partials: DataFrame) -> DataFrame:
    """The partials of several tables, one row per notebook."""
    add = {"sum": F.sum, "n": F.sum, "max": F.max}
    columns = [c for c in partials.columns if c != "kernel_id"]
    return partials.groupBy("kernel_id").agg(*[add[c.split("_")[0]](c).alias(c) for c in columns])


def metrics_of_partials(partials: DataFrame, drop_bad_ids: bool = False, min_loc: int = 1) -> DataFrame:
    """What ``code_notebook_metrics`` gives for all the cells."""
    whole = added_partials(partials).select(
        "kernel_id",
        *[F.coalesce(f"sum_{m}", F.lit(0)).alias(m) for m in schemas.CODE_SUMS],
        *[F.try_divide(f"sum_{m}", f"n_{m}").alias(name) for m, name in schemas.CODE_MEANS.items()],
        *[F.col(f"max_{m}").alias(name) for m, name in schemas.CODE_MAXIMA.items()],
        F.col("n_cells").alias("CC"),
    )
    return finished_code_metrics(whole, drop_bad_ids, min_loc)


class PartialTables:
    """The tables of a folder, one per run of batches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _path(self, name: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def runs(self) -> list[tuple[int, int]]:
        """First and last batch of the finished tables that no larger one covers."""
        system, root = self._path("")
        if not system.exists(root):
            return []
        found = []
        for status in system.listStatus(root):
            first, _, last = status.getPath().getName().removeprefix("batches=").partition("-")
            if first.isdigit() and last.isdigit() and system.exists(self._path(f"batches={first}-{last}/_SUCCESS")[1]):
                found.append((int(first), int(last)))
        found.sort(key=lambda run: (run[0], -run[1]))
        kept: list[tuple[int, int]] = []
        for run in found:
            if not kept or run[1] > kept[-1][1]:
                kept.append(run)
        return kept

    def write(self, partials: DataFrame, first: int, last: int) -> None:
        partials.write.mode("overwrite").parquet(f"{self.folder}/batches={first}-{last}")

    def read(self, runs: list[tuple[int, int]]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/batches={first}-{last}" for first, last in runs])

    def compact(self, before: int) -> None:
        """Add up full generations of batches before ``before``.  The batch at work may be run again, so it is left alone."""
        while True:
            runs = [r for r in self.runs() if r[1] < before]
            # A table of generation g covers FANOUT^g batches.
            for at in range(len(runs) - FANOUT + 1):
                group = runs[at : at + FANOUT]
                if len({last - first for first, last in group}) == 1 and all(a[1] + 1 == b[0] for a, b in zip(group, group[1:])):
                    self.write(added_partials(self.read(group)), group[0][0], group[-1][1])
                    for first, last in group:
                        system, target = self._path(f"batches={first}-{last}")
                        system.delete(target, True)
                    break
            else:
                return


def stream_code_partials(cells: DataFrame, popularity: DataFrame | None, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the partials of newly landed code cells; a batch that is run again replaces its own table."""
    known = settled(popularity)

    def write(batch: DataFrame, batch_id: int) -> None:
        tables = PartialTables(batch.sparkSession, target)
        tables.compact(batch_id)
        metrics = code_cell_metrics(spread(batch), known)
        tables.write(code_partials(metrics if known is not None else metrics.withColumn("EAP", F.lit(0.0))), batch_id, batch_id)

    return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_notebook_metrics(spark: SparkSession, target: str, drop_bad_ids: bool = False, min_loc: int = 1) -> DataFrame:
    """Metrics of all notebooks from what has arrived so far."""
    tables = PartialTables(spark, target)
    return metrics_of_partials(tables.read(tables.runs()), drop_bad_ids, min_loc)
