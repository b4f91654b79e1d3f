"""Queries over notebooks: aggregates, joins and key cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nbgauge import schemas
from nbgauge.operators.cleaning import one_row_per_key
from nbgauge.operators.notebook import code_notebook_metrics, join_notebook_metrics, markdown_notebook_metrics
from nbgauge.operators.texts import assemble_texts, text_pairs
from nbgauge.plans.cells import code_cell_metrics, corpus_popularity, markdown_cell_metrics
from nbgauge.plans.notebooks import notebook_metrics
from nbgauge.streaming import jobs, partials
from workloads import sql
from workloads.cells import work_dir
from workloads.registry import collection
from workloads.views import source_table, view

QUERIES, ORACLES, query = collection()


def shown(df: DataFrame, names, *keys: str) -> DataFrame:
    """Keys and metrics, fractions rounded."""
    return df.select(
        *(keys or ("kernel_id",)),
        *[
            F.round(F.col(n), 6).alias(n) if n in sql.NOTEBOOK_FLOATS else F.col(n).cast("bigint").alias(n)
            for n in names
        ],
    )


def code_metrics(spark, sf_dir):
    cells = view(spark, sf_dir, "code_cells")
    return code_cell_metrics(cells, corpus_popularity(cells))


def markdown_metrics(spark, sf_dir):
    return markdown_cell_metrics(view(spark, sf_dir, "markdown_cells"))


def all_notebook_metrics(spark, sf_dir, user_pt=None, how="left"):
    return notebook_metrics(code_metrics(spark, sf_dir), markdown_metrics(spark, sf_dir), user_pt, how)


@query(
    sql.cte(*sql.NOTEBOOK_METRICS[:-4])
    + f"SELECT kernel_id, {sql.notebook_columns(schemas.CODE_NOTEBOOK_METRICS)} FROM code_nb"
)
def notebook_code_metrics(spark, sf_dir):
    return shown(code_notebook_metrics(code_metrics(spark, sf_dir)), schemas.CODE_NOTEBOOK_METRICS)


@query(
    sql.cte(*sql.NOTEBOOK_METRICS[:-4])
    + f"SELECT kernel_id, {sql.notebook_columns(schemas.CODE_NOTEBOOK_METRICS)} FROM code_nb"
)
def stream_notebook_partials(spark, sf_dir):
    """The same from a stream of cells in which every notebook arrives over many batches."""
    target, cells = work_dir(spark), view(spark, sf_dir, "code_cells")
    popularity = corpus_popularity(cells)
    cells.repartition(12, "cell_index", "source").write.parquet(f"{target}/landed")
    landed = jobs.read_cell_stream(spark, f"{target}/landed", cells.schema, files_per_batch=1)
    partials.stream_code_partials(landed, popularity, f"{target}/partials", f"{target}/state").awaitTermination()
    return shown(partials.current_notebook_metrics(spark, f"{target}/partials"), schemas.CODE_NOTEBOOK_METRICS)


@query(
    sql.cte(*sql.NOTEBOOK_METRICS[-4:-1])
    + f"SELECT kernel_id, {sql.notebook_columns(schemas.MARKDOWN_NOTEBOOK_METRICS)} FROM md_nb"
)
def notebook_markdown_metrics(spark, sf_dir):
    return shown(markdown_notebook_metrics(markdown_metrics(spark, sf_dir)), schemas.MARKDOWN_NOTEBOOK_METRICS)


@query(sql.cte(*sql.NOTEBOOK_METRICS) + f"SELECT kernel_id, {sql.notebook_columns(schemas.NOTEBOOK_METRICS)} FROM notebooks")
def notebook_metrics_left(spark, sf_dir):
    return shown(all_notebook_metrics(spark, sf_dir), schemas.NOTEBOOK_METRICS)


@query(
    sql.cte(*sql.NOTEBOOK_METRICS)
    + f"SELECT kernel_id, {sql.notebook_columns(schemas.NOTEBOOK_METRICS, zero=True)} FROM code_nb FULL JOIN md_nb USING (kernel_id)"
)
def notebook_metrics_full(spark, sf_dir):
    return shown(all_notebook_metrics(spark, sf_dir, how="full"), schemas.NOTEBOOK_METRICS)


@query(
    sql.cte(*sql.NOTEBOOK_METRICS)
    + f"SELECT n.kernel_id, {sql.notebook_columns(schemas.NOTEBOOK_METRICS, 'n.')}, CAST(coalesce(c.c_custkey % 6, 0) AS BIGINT) AS PT "
    "FROM notebooks n LEFT JOIN customer c ON n.kernel_id = c.c_custkey"
)
def notebook_author_tier(spark, sf_dir):
    tiers = source_table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("Unnamed: 0"),
        F.col("c_custkey").alias("Id_x"),
        (F.col("c_custkey") % 6).cast("int").alias("PerformanceTier"),
    )
    return shown(all_notebook_metrics(spark, sf_dir, tiers), (*schemas.NOTEBOOK_METRICS, "PT"))


# Ids as a dump holds them.  DuckDB's cast would take '12.0' for 12.
RAW_METRICS = ("LOC", "NBD", "ID", "OPRND", "CC")
CLEAN_ID = "CASE WHEN regexp_full_match(kernel_id, '[0-9]+') THEN CAST(kernel_id AS BIGINT)"
RAW_NOTEBOOKS = (
    sql.view("raw_code_cells"),
    sql.cell_metrics("raw_code_cells", "LOC", "NBD", "ID", "OPRND"),
    (
        "grouped",
        "SELECT kernel_id, sum(LOC) AS LOC, max(NBD) AS NBD, sum(ID) AS ID, sum(OPRND) AS OPRND, count(*) AS CC FROM cell_metrics "
        "WHERE kernel_id IS NOT NULL AND kernel_id <> 'train_emb' GROUP BY kernel_id HAVING sum(LOC) > 1",
    ),
)


def raw_code_metrics(spark, sf_dir):
    cells = view(spark, sf_dir, "raw_code_cells")
    return code_cell_metrics(cells).withColumn("EAP", F.lit(0.0))


@query(sql.cte(*RAW_NOTEBOOKS) + f"SELECT {CLEAN_ID} ELSE 0 END AS kernel_id, {sql.notebook_columns(RAW_METRICS)} FROM grouped")
def notebook_ids_cleaned(spark, sf_dir):
    return shown(code_notebook_metrics(raw_code_metrics(spark, sf_dir)), RAW_METRICS)


@query(
    sql.cte(*RAW_NOTEBOOKS)
    + f"SELECT * FROM (SELECT {CLEAN_ID} END AS kernel_id, {sql.notebook_columns(RAW_METRICS)} FROM grouped) WHERE kernel_id IS NOT NULL"
)
def notebook_bad_ids_dropped(spark, sf_dir):
    return shown(code_notebook_metrics(raw_code_metrics(spark, sf_dir), drop_bad_ids=True), RAW_METRICS)


@query(
    sql.cte(*RAW_NOTEBOOKS, sql.view("markdown_cells"), sql.markdown_metrics(), ("md_nb", sql.markdown_aggregate()))
    + f"SELECT c.kernel_id, {sql.notebook_columns(RAW_METRICS, 'c.')}, CAST(coalesce(m.MC, 0) AS BIGINT) AS MC, "
    f"CAST(coalesce(m.MW, 0) AS BIGINT) AS MW FROM (SELECT {CLEAN_ID} ELSE 0 END AS kernel_id, * EXCLUDE (kernel_id) FROM grouped) c "
    "LEFT JOIN md_nb m ON c.kernel_id = m.kernel_id"
)
def notebook_raw_join(spark, sf_dir):
    """Dump ids joined with markdown: what is no number meets notebook 0."""
    code = code_notebook_metrics(raw_code_metrics(spark, sf_dir))
    joined = join_notebook_metrics(code, markdown_notebook_metrics(markdown_metrics(spark, sf_dir)))
    return shown(joined, (*RAW_METRICS, "MC", "MW"))


RAW_ID = (
    "CASE WHEN kernel_id % 9 = 4 THEN 'train_emb' WHEN kernel_id % 9 IN (3, 5) THEN concat(kernel_id, '.0') "
    "WHEN kernel_id % 9 = 6 THEN NULL ELSE concat('', kernel_id) END"
)


def _raw_both(junk: str) -> str:
    """``junk``: the id of what is no number; rows without one go."""
    clean = f"{CLEAN_ID} ELSE {junk} END AS kernel_id"
    return (
        sql.cte(
            *RAW_NOTEBOOKS, sql.view("markdown_cells"), sql.markdown_metrics(),
            ("md_raw", f"SELECT {RAW_ID} AS kernel_id, * EXCLUDE (kernel_id) FROM md_metrics"),
            ("md_clean", f"SELECT {clean}, * EXCLUDE (kernel_id) FROM md_raw WHERE kernel_id <> 'train_emb'"),
            ("md_nb", sql.markdown_aggregate("md_clean")),
        )
        + f"SELECT c.kernel_id, {sql.notebook_columns(RAW_METRICS, 'c.')}, CAST(coalesce(m.MC, 0) AS BIGINT) AS MC, "
        f"CAST(coalesce(m.MW, 0) AS BIGINT) AS MW FROM (SELECT {clean}, * EXCLUDE (kernel_id) FROM grouped) c "
        "LEFT JOIN md_nb m ON c.kernel_id = m.kernel_id WHERE c.kernel_id IS NOT NULL"
    )


def _raw_both_joined(spark, sf_dir, drop_bad_ids):
    notes = markdown_metrics(spark, sf_dir).withColumn("kernel_id", F.expr(RAW_ID))
    code = code_notebook_metrics(raw_code_metrics(spark, sf_dir), drop_bad_ids)
    joined = join_notebook_metrics(code, markdown_notebook_metrics(notes, drop_bad_ids))
    return shown(joined, (*RAW_METRICS, "MC", "MW"))


@query(_raw_both("0"))
def notebook_raw_join_both_sides(spark, sf_dir):
    """Ids that are no numbers on both sides: as many rows as notebooks with code."""
    return _raw_both_joined(spark, sf_dir, False)


@query(_raw_both("NULL"))
def notebook_raw_join_bad_ids_dropped(spark, sf_dir):
    return _raw_both_joined(spark, sf_dir, True)


@query(
    "SELECT o_custkey AS kernel_id, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER "
    "(PARTITION BY o_custkey ORDER BY o_orderkey, o_orderstatus) AS r FROM orders) WHERE r = 1"
)
def one_row_per_notebook(spark, sf_dir):
    rows = source_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("kernel_id"), "o_orderkey", "o_orderstatus"
    )
    return one_row_per_key(rows)


# -- texts --------------------------------------------------------------------


def mixed_cells(spark, sf_dir):
    kinds = F.when(F.col("role") == "user", "markdown").when(F.col("role") == "assistant", "code").otherwise("raw")
    return source_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("kernel_id"), F.col("turn").alias("cell_index"), kinds.alias("cell_type"),
        F.col("text").alias("source"),
    )


def _joined_sql(role: str) -> str:
    return (
        f"coalesce(string_agg(text, concat(' ', chr(10), ' ') ORDER BY turn, text) FILTER (WHERE role = '{role}'), '')"
    )


TEXTS = f"SELECT conv_id AS kernel_id, {_joined_sql('assistant')} AS code, {_joined_sql('user')} AS markdown FROM conversations GROUP BY conv_id"


@query(TEXTS)
def text_assembly(spark, sf_dir):
    return assemble_texts(mixed_cells(spark, sf_dir))


@query(
    f"SELECT kernel_id, code, substr(markdown, 1, 300) AS markdown, concat(substr(markdown, 1, 300), chr(10), code) AS text FROM ({TEXTS})"
)
def text_pairs_truncated(spark, sf_dir):
    return text_pairs(assemble_texts(mixed_cells(spark, sf_dir)))
