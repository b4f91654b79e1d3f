"""Cell metrics of a corpus: pass one finds the popularity of imports, pass two the metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nbgauge import schemas
from nbgauge.functions import code as C
from nbgauge.functions import markdown as M
from nbgauge.functions.complexity import cyclomatic_complexity
from nbgauge.functions.scan import scan_of
from nbgauge.functions.text import or_empty
from nbgauge.operators.popularity import api_popularity, with_import_score, with_imports
from nbgauge.plans.popularity import updated_popularity
from nbgauge.sources.tables import limit_cells


def corpus_popularity(code_cells: DataFrame, baseline: str = "sklearn", strict: bool = True) -> DataFrame:
    """Popularity of imported names over all code cells."""
    return api_popularity(with_imports(code_cells.select("source"), strict), baseline)


def code_cell_metrics(
    code_cells: DataFrame,
    popularity: DataFrame | None = None,
    strict: bool = True,
    fill_null: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """All metrics of code cells; ``EAP`` only with a popularity table.

    ``keep`` names further columns to hand on.  Map-only.  Plain cells are scanned many at once; of other cells the arrays
    that several metrics need are projected first.  Catalyst keeps the projections apart and drops what a query does not ask for.
    """
    source, output = F.col("source"), F.col("output_type")
    cells = code_cells.select("kernel_id", "cell_index", "source", "output_type", *keep)
    if fill_null:
        cells = cells.withColumn("source", or_empty(source))
    # Both steps get the cells in one hand-over.
    scanned = cells.withColumns({"_scan": scan_of(source), "CyC": cyclomatic_complexity(source)})
    plain = F.col("_scan").isNotNull()

    def other(value: Column) -> Column:
        return F.when(~plain, value)

    def metric(name: str, value: Column) -> Column:
        return F.coalesce(F.col(f"_scan.{name}"), value).alias(name)

    symbols = scanned.withColumn("_symbols", other(C.operator_symbols(source)))
    arrays = with_imports(symbols, strict).withColumns(
        {
            "_operators": other(C.operator_counts_of(source, F.col("_symbols"))),
            "_operands": other(C.operand_pieces(source)),
            "_tokens": other(C.identifier_tokens(source)),
            "_calls": other(C.call_arguments(source)),
        }
    )
    operators, operands, tokens = F.col("_operators"), F.col("_operands"), F.col("_tokens")
    metrics = arrays.select(
        "kernel_id",
        "cell_index",
        "API",
        C.lines_of_code(source).alias("LOC"),
        C.blank_cell(source).alias("BLC"),
        metric("UDF", C.function_definitions(source)),
        metric("I", C.import_statements(source)),
        metric("EH", C.exception_handlers(source)),
        metric("ALLC", C.mean_line_length(source)),
        C.display_outputs(output).alias("NVD"),
        C.result_outputs(output).alias("NEC"),
        metric("S", C.statements(source)),
        metric("P", C.parameters_of(F.col("_calls"))),
        metric("KLCID", C.identifiers_per_line(source)),
        metric("NBD", C.nested_block_depth(source)),
        metric("OPRATOR", C.operators_of(operators)),
        metric("OPRND", F.size(operands).cast("bigint")),
        metric("UOPRND", F.size(F.array_distinct(operands)).cast("bigint")),
        metric("UOPRATOR", C.unique_operators_of(operators)),
        metric("ID", C.identifiers_of(tokens)),
        metric("ALID", C.mean_identifier_length_of(tokens)),
        metric("MLID", C.max_identifier_length_of(tokens)),
        "CyC",
        F.when(plain, C.block_lines(source) + F.col("_scan.hash_lines")).otherwise(C.comment_lines(source)).alias("LOCom"),
        metric("CW", C.comment_words(source)),
        *keep,
    )
    if popularity is None:
        return metrics
    scored = with_import_score(metrics, popularity)
    return scored.select(*schemas.CODE_CELL_COLUMNS, *keep)


def markdown_cell_metrics(markdown_cells: DataFrame, fill_null: bool = True) -> DataFrame:
    """All metrics of markdown cells; map-only."""
    source = or_empty(F.col("source")) if fill_null else F.col("source")
    return markdown_cells.select("kernel_id", "cell_index", *_markdown_columns(source))


def _markdown_columns(source: Column) -> list[Column]:
    return [
        M.markdown_lines(source).alias("LMC"),
        *[M.headers(source, level).alias(f"H{level}") for level in (1, 2, 3)],
        M.markdown_words(source).alias("MW"),
    ]


def mixed_cell_metrics(cells: DataFrame, popularity: DataFrame) -> DataFrame:
    """Code and markdown metrics of rows with a ``cell_type``, from one pass.

    Metrics of the kind a cell is not are those of an empty text.
    """
    source, kind = F.col("source"), F.col("cell_type")
    split = cells.select(
        "kernel_id",
        "cell_index",
        "cell_type",
        F.when(kind == "code", source).alias("source"),
        F.when(kind == "code", F.col("output_type")).alias("output_type"),
        F.when(kind == "markdown", source).otherwise(F.lit("")).alias("note"),
    )
    metrics = code_cell_metrics(split, popularity, fill_null=False, keep=("cell_type", "note"))
    return metrics.select(*[c for c in metrics.columns if c != "note"], *_markdown_columns(F.col("note")))


def run_code_metrics(
    spark: SparkSession,
    code_cells: DataFrame,
    popularity_path: str,
    metrics_path: str,
    limit_rows: int = 0,
    baseline: str = "sklearn",
) -> DataFrame:
    """Write the metrics of all code cells; popularity always covers the whole corpus."""
    popularity = updated_popularity(spark, code_cells, popularity_path, baseline)
    metrics = code_cell_metrics(limit_cells(code_cells, limit_rows), popularity)
    metrics.write.mode("overwrite").parquet(metrics_path)
    return spark.read.parquet(metrics_path)


def run_markdown_metrics(
    spark: SparkSession, markdown_cells: DataFrame, metrics_path: str, limit_rows: int = 0
) -> DataFrame:
    metrics = markdown_cell_metrics(limit_cells(markdown_cells, limit_rows))
    metrics.write.mode("overwrite").parquet(metrics_path)
    return spark.read.parquet(metrics_path)
