"""Readers and writers of the library's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nbgauge import schemas
from nbgauge.sources.records import csv_records


def read_csv(
    spark: SparkSession, path: str, schema: str | None = None, null_words: Sequence[str] = (), whole_files: bool = False
) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes.

    Without a schema all columns are text, to be cast by the cleaning steps.
    With one, its columns are taken by their names, in whatever order the file
    has them; values that do not fit become NULL, a missing column is an error.
    ``null_words`` are whole fields read as NULL.

    A file is read by as many tasks as it has splits, three times over; records end
    with a line feed, with or without a carriage return.  ``whole_files`` reads each
    file in one task instead, and also takes carriage returns alone.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    # Of the first file only the head is read here.
    rows = reader.csv(path)
    names = rows.columns
    if not whole_files and names:
        fields = ", ".join(f"c{i} STRING" for i in range(len(names)))
        parsed = F.from_csv("record", fields, {"escape": '"', "multiLine": "true"})
        rows = csv_records(spark, path).select(parsed.alias("r")).select(*[F.col(f"r.c{i}").alias(name) for i, name in enumerate(names)])
    if schema:
        wanted = spark.createDataFrame([], schema).schema
        rows = rows.select(*[F.col(f"`{c.name}`").try_cast(c.dataType).alias(c.name) for c in wanted])
    for word in null_words:
        texts = [c for c, t in rows.dtypes if t == "string"]
        rows = rows.withColumns({c: F.nullif(F.col(c), F.lit(word)) for c in texts})
    return rows


def csv_to_parquet(
    spark: SparkSession, source: str, target: str, schema: str, files: int | None = None
) -> DataFrame:
    """Convert a CSV table to Parquet, in ``files`` files or in files of even size."""
    rows = read_csv(spark, source, schema)
    rows = rows.repartition(files) if files else rows.hint("rebalance")
    rows.write.mode("overwrite").parquet(target)
    return spark.read.schema(schema).parquet(target)


def read_table(spark: SparkSession, path: str, schema: str | None = None, columns: Sequence[str] = ()):
    """Parquet table, optionally a choice of its columns."""
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return rows.select(*columns) if columns else rows


def read_code_cells(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.CODE_CELLS)


def read_markdown_cells(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.MARKDOWN_CELLS)


def read_labelled_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Labelled comments exported as CSV; a missing mark is 0."""
    rows = read_csv(spark, path)
    marks = [c for c in rows.columns if c not in ("Id", "Text")]
    return rows.withColumns({c: F.coalesce(F.col(f"`{c}`").try_cast("int"), F.lit(0)) for c in marks})


def limit_cells(cells: DataFrame, rows: int) -> DataFrame:
    """The first cells by notebook and index; a limit below 1 is none."""
    from nbgauge.operators.ordering import lowest

    return cells if rows <= 0 else lowest(cells, rows, "kernel_id", "cell_index")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_metrics_csv(df: DataFrame, path: str) -> None:
    """All rows as CSV with a header; lists are joined by blanks."""
    lists = [f.name for f in df.schema if f.dataType.typeName() == "array"]
    rows = df.withColumns({c: F.array_join(c, " ") for c in lists}) if lists else df
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_metrics_json(df: DataFrame, path: str) -> None:
    """One JSON object per notebook."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
