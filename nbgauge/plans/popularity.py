"""Popularity of a corpus whose files come, change and go.

Imports are counted once per file.  A manifest (path, size, time of change, generation
of the counts) tells which files were counted; an update reads new and rewritten files
only, and leaves out what was counted of files that are gone.  The manifest is a table
like any other: files are compared by joins.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nbgauge import schemas
from nbgauge.operators.popularity import api_popularity, popularity_from_counts, with_imports
from nbgauge.session import cut_lineage

MANIFEST = "file string, size bigint, modified timestamp, generation int"
COUNTS = "file string, api string, n bigint, generation int"
#: New files that are asked for by name; of more, all files are read and the new ones kept.
NAMED_FILES = 10_000
#: Generations of counts before all live ones are written as one.
GENERATIONS = 32

_KEY = ["file", "size", "modified"]


def corpus_files(cells: DataFrame) -> DataFrame | None:
    """file, size, modified of a table read straight from files; None for any other."""
    try:
        found = cells.select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified")
        )
    except AnalysisException:
        return None
    return found.distinct()


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def finished(spark: SparkSession, folder: str) -> bool:
    """Whether a table was written to its end."""
    system, target = _file_system(spark, f"{folder}/_SUCCESS")
    return system.exists(target)


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    system, target = _file_system(spark, folder)
    if not system.exists(target):
        return []
    names = [status.getPath().getName() for status in system.listStatus(target)]
    numbers = [n.removeprefix(prefix) for n in names if n.startswith(prefix)]
    return sorted(int(n) for n in numbers if n.isdigit())


def _delete(spark: SparkSession, folder: str) -> None:
    system, target = _file_system(spark, folder)
    system.delete(target, True)


def file_counts(cells: DataFrame, strict: bool = True) -> DataFrame:
    """file, api, n: imports per name in each file; repeats in a cell count."""
    lists = with_imports(cells.select("source", F.col("_metadata.file_path").alias("file")), strict)
    names = lists.select("file", F.explode_outer("API").alias("api")).where(F.col("api").isNotNull())
    return names.groupBy("file", "api").agg(F.count(F.lit(1)).alias("n"))


def _of_files(cells: DataFrame, files: DataFrame, n: int) -> DataFrame:
    """The cells of some files; if they are few, Spark opens no others."""
    path = F.col("_metadata.file_path")
    if n <= NAMED_FILES:
        return cells.where(path.isin([r["file"] for r in files.select("file").collect()]))
    return cells.withColumn("_file", path).join(files.select(F.col("file").alias("_file")), "_file", "left_semi")


def updated_popularity(spark: SparkSession, cells: DataFrame, path: str, baseline: str = "sklearn", strict: bool = True, refresh: bool = False) -> DataFrame:
    """The popularity table under ``path``, brought up to the files that ``cells`` is read from.

    Beside it lie counts per file and the manifest, in ``path``-parts.  Other names are
    counted with another ``strict``, so that begins anew; another ``baseline`` only divides
    anew.  A table that is not read straight from files is counted whole every time.
    """
    path = path.rstrip("/")
    parts, note = f"{path}-parts", f"{path}-made-from"
    now = corpus_files(cells)
    if now is None:
        api_popularity(with_imports(cells.select("source"), strict), baseline).write.mode("overwrite").parquet(path)
        return spark.read.schema(schemas.API_POPULARITY).parquet(path)
    now = cut_lineage(now)
    versions = [v for v in _numbers(spark, parts, "v") if finished(spark, f"{parts}/v{v}")]
    last = versions[-1] if versions else 0
    number = max(_numbers(spark, parts, "v"), default=0) + 1
    about = json.dumps({"strict": strict, "columns": sorted(cells.dtypes)})
    same_kind = last and not refresh and spark.read.text(f"{parts}/v{last}-about").first()["value"] == about
    old = spark.read.schema(MANIFEST).parquet(f"{parts}/v{last}") if same_kind else spark.createDataFrame([], MANIFEST)

    kept = now.join(old, _KEY).select(*_KEY, "generation")
    added = cut_lineage(now.join(old, _KEY, "left_anti"))
    n_added, n_kept = added.count(), kept.count()
    made_from = json.dumps({"version": last, "baseline": baseline})
    if same_kind and not n_added and n_kept == old.count():
        if finished(spark, path) and finished(spark, note) and spark.read.text(note).first()["value"] == made_from:
            return spark.read.schema(schemas.API_POPULARITY).parquet(path)
        number = last
    else:
        if n_added:
            some = _of_files(cells, added, n_added) if n_kept else cells
            file_counts(some, strict).write.mode("overwrite").parquet(f"{parts}/counts/generation={number}")
        manifest = kept.unionByName(added.withColumn("generation", F.lit(number)))
        if kept.select("generation").distinct().count() >= GENERATIONS:
            _live(spark, parts, cut_lineage(manifest)).drop("generation").write.mode("overwrite").parquet(f"{parts}/counts/generation={number + 1}")
            manifest = now.withColumn("generation", F.lit(number + 1))
            number += 1
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{parts}/v{number}-about")
        # Written last: an update that broke off is made again.
        manifest.select(*MANIFEST.replace(",", "").split()[::2]).write.mode("overwrite").parquet(f"{parts}/v{number}")
    manifest = spark.read.schema(MANIFEST).parquet(f"{parts}/v{number}")
    counts = _live(spark, parts, manifest).groupBy("api").agg(F.sum("n").alias("n"))
    popularity_from_counts(counts, baseline).write.mode("overwrite").parquet(path)
    spark.createDataFrame([(json.dumps({"version": number, "baseline": baseline}),)], "value string").coalesce(1).write.mode("overwrite").text(note)
    _forget(spark, parts, number, manifest)
    return spark.read.schema(schemas.API_POPULARITY).parquet(path)


def _live(spark: SparkSession, parts: str, manifest: DataFrame) -> DataFrame:
    """Counts of the files of a manifest."""
    if not _numbers(spark, f"{parts}/counts", "generation="):
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).parquet(f"{parts}/counts").join(manifest.select("file", "generation"), ["file", "generation"])


def _forget(spark: SparkSession, parts: str, number: int, manifest: DataFrame) -> None:
    """Delete versions before this one, and generations none of whose files is there any more."""
    for v in _numbers(spark, parts, "v"):
        if v < number:
            _delete(spark, f"{parts}/v{v}")
            _delete(spark, f"{parts}/v{v}-about")
    live = {r["generation"] for r in manifest.select("generation").distinct().collect()}
    for generation in _numbers(spark, f"{parts}/counts", "generation="):
        if generation < number and generation not in live:
            _delete(spark, f"{parts}/counts/generation={generation}")
