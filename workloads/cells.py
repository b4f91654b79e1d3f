"""Queries over cells: metrics, imports, popularity, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nbgauge import schemas
from nbgauge.functions import code as C
from nbgauge.operators.notebook import clean_cell_index, drop_repeated_cells
from nbgauge.operators.popularity import api_counts, join_import_score, with_import_score, with_imports
from nbgauge.plans.cells import code_cell_metrics, corpus_popularity, markdown_cell_metrics, run_code_metrics
from nbgauge.plans.popularity import updated_popularity
from nbgauge.plans.notebooks import metrics_of_notebooks
from nbgauge.session import shared_dir
from nbgauge.sources import notebooks as nb
from nbgauge.sources.tables import limit_cells, read_csv, read_labelled_sheet, read_table, write_metrics_csv, write_table
from nbgauge.streaming import corrections, jobs
from workloads import sql
from workloads.registry import collection
from workloads.views import source_stream, source_table, view

QUERIES, ORACLES, query = collection()

FLOATS = ("ALLC", "KLCID", "NBD", "CyC", "EAP")


def shown(df: DataFrame, *names: str) -> DataFrame:
    """Keys and metrics, fractions rounded."""
    return df.select(
        "kernel_id", "cell_index", *[F.round(F.col(n), 6).alias(n) if n in FLOATS else F.col(n).cast("bigint").alias(n) for n in names]
    )


def work_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"


def _cell_query(name: str, *metrics: str, source: str = "code_cells") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(code_cell_metrics(view(spark, sf_dir, source)), *metrics)

    run.__name__ = name
    query(sql.cell_query(*metrics, source=source))(run)


_cell_query("cell_size", "LOC", "BLC", "ALLC", "NBD")
_cell_query("cell_statements", "UDF", "I", "EH", "S", "NVD", "NEC")
_cell_query("cell_parameters", "P")
_cell_query("cell_operators", "OPRATOR", "UOPRATOR")
_cell_query("cell_operands", "OPRND", "UOPRND")
_cell_query("cell_identifiers", "ID", "ALID", "MLID", "KLCID")
_cell_query("cell_comments", "LOCom", "CW")
_cell_query("cell_complexity", "CyC")
# The same over natural text with several alphabets.
_cell_query("text_cell_size", "LOC", "BLC", "ALLC", "NBD", source="text_cells")
_cell_query("text_cell_tokens", "OPRATOR", "UOPRATOR", "OPRND", "UOPRND", "ID", "ALID", "MLID", "KLCID", "P", source="text_cells")


@query(
    sql.cte(sql.view("code_cells"))
    + f"SELECT kernel_id, cell_index, array_to_string(list_sort({sql.IMPORTS}), '|') AS names, "
    f"array_to_string(list_sort({sql.IMPORTS}), '|') AS all_names FROM code_cells"
)
def cell_imports(spark, sf_dir):
    cells = view(spark, sf_dir, "code_cells")

    def text(strict):
        return F.array_join(F.array_sort(C.imported_names(F.col("source"), strict)), "|")

    return cells.select("kernel_id", "cell_index", text(True).alias("names"), text(False).alias("all_names"))


@query(
    sql.cte(sql.view("markdown_cells"))
    + f"SELECT kernel_id, cell_index, {', '.join(f'{e} AS {n}' for n, e in sql.MARKDOWN_METRICS.items())} FROM markdown_cells"
)
def markdown_cell_table(spark, sf_dir):
    return markdown_cell_metrics(view(spark, sf_dir, "markdown_cells"))


@query(sql.cte(sql.view("code_cells"), *sql.POPULARITY[:2]) + "SELECT api, CAST(n AS BIGINT) AS n FROM api_n")
def api_import_counts(spark, sf_dir):
    return api_counts(with_imports(view(spark, sf_dir, "code_cells")))


@query(sql.cte(sql.view("code_cells"), *sql.POPULARITY[:3]) + "SELECT api, round(score, 6) AS score FROM popularity")
def api_popularity(spark, sf_dir):
    popularity = corpus_popularity(view(spark, sf_dir, "code_cells"))
    return popularity.select("api", F.round("score", 6).alias("score"))


def _changed_view(keep: str) -> tuple[str, str]:
    name, text = sql.view("code_cells")
    return name, f"SELECT * FROM ({text}) WHERE {keep}"


@query(sql.cte(_changed_view("kernel_id % 5 IN (0, 3, 4)"), *sql.POPULARITY[:3]) + "SELECT api, round(score, 6) AS score FROM popularity")
def popularity_updated(spark, sf_dir):
    """Popularity over two generations of a corpus: one part stays, one is rewritten, one goes, one is new."""
    target, cells = work_dir(spark), view(spark, sf_dir, "code_cells")

    def put(part: str, fifth: int) -> None:
        cells.where(f"kernel_id % 5 = {fifth}").write.mode("overwrite").parquet(f"{target}/{part}")

    def popularity(*parts: str) -> DataFrame:
        return updated_popularity(spark, spark.read.parquet(*[f"{target}/{p}" for p in parts]), f"{target}/popularity")

    for fifth, part in enumerate(("stays", "changes", "goes")):
        put(part, fifth)
    popularity("stays", "changes", "goes")
    put("changes", 3)
    put("new", 4)
    return popularity("stays", "changes", "new").select("api", F.round("score", 6).alias("score"))


EAP_ORACLE = sql.cte(sql.view("code_cells"), *sql.POPULARITY) + "SELECT kernel_id, cell_index, round(EAP, 6) AS EAP FROM cell_eap"


@query(EAP_ORACLE)
def cell_import_score(spark, sf_dir):
    cells = view(spark, sf_dir, "code_cells")
    return shown(with_import_score(with_imports(cells), corpus_popularity(cells)), "EAP")


@query(EAP_ORACLE)
def cell_import_score_joined(spark, sf_dir):
    cells = view(spark, sf_dir, "code_cells")
    return shown(join_import_score(with_imports(cells).drop("source"), corpus_popularity(cells)), "EAP")


ALL_CODE = [c for c in schemas.CODE_CELL_COLUMNS if c not in ("kernel_id", "cell_index", "API")]


@query(sql.cte(*sql.FULL_CELL_METRICS) + f"SELECT kernel_id, cell_index, {', '.join(sql.output(n) for n in ALL_CODE)} FROM cell_metrics")
def code_cell_table(spark, sf_dir):
    cells = view(spark, sf_dir, "code_cells")
    return shown(code_cell_metrics(cells, corpus_popularity(cells)), *ALL_CODE)


@query("SELECT CAST(turn AS BIGINT) AS cell_index, CAST(count(*) AS BIGINT) AS n FROM conversations WHERE role = 'assistant' AND "
       "coalesce(conv_id % 9, -1) <> 4 GROUP BY 1")
def cleaned_cell_index(spark, sf_dir):
    cells = view(spark, sf_dir, "raw_code_cells").withColumn("cell_index", F.col("cell_index").cast("string"))
    cleaned = clean_cell_index(cells)
    return cleaned.groupBy(F.col("cell_index").cast("bigint").alias("cell_index")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id AS kernel_id, turn AS cell_index, length(text) AS size FROM conversations GROUP BY ALL")
def repeated_cells_dropped(spark, sf_dir):
    cells = source_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("kernel_id"), F.col("turn").alias("cell_index"), F.length("text").cast("bigint").alias("size")
    )
    return drop_repeated_cells(cells.unionByName(cells))


@query(
    sql.cte(sql.view("text_cells"))
    + "SELECT kernel_id, cell_index, length(source) AS size FROM text_cells ORDER BY kernel_id, cell_index LIMIT 500"
)
def limited_cells(spark, sf_dir):
    cells = limit_cells(view(spark, sf_dir, "text_cells"), 500)
    return cells.select("kernel_id", "cell_index", F.length("source").cast("bigint").alias("size"))


@query(
    sql.cte(sql.view("text_cells"), sql.cell_metrics("text_cells", "LOC", "NBD", "ID"))
    + "SELECT kernel_id, cell_index, LOC, round(NBD, 6) AS NBD, ID FROM cell_metrics"
)
def csv_round_trip(spark, sf_dir):
    """Cells written as CSV and read back, line breaks and quotes included."""
    target = work_dir(spark)
    write_metrics_csv(view(spark, sf_dir, "text_cells"), target)
    cells = read_csv(spark, target, "kernel_id BIGINT, cell_index BIGINT, source STRING, output_type STRING")
    return shown(code_cell_metrics(cells), "LOC", "NBD", "ID")


@query(
    sql.cte(sql.view("text_cells"), sql.cell_metrics("text_cells", "LOC", "ID"))
    + "SELECT kernel_id, cell_index, LOC, ID FROM cell_metrics WHERE kernel_id IN (3, 4)"
)
def partitioned_metrics(spark, sf_dir):
    """Cell metrics written by notebook and read back for two of them."""
    target = work_dir(spark)
    write_table(shown(code_cell_metrics(view(spark, sf_dir, "text_cells")), "LOC", "ID"), target, ["kernel_id"])
    kinds = "kernel_id BIGINT, cell_index BIGINT, LOC BIGINT, ID BIGINT"
    return read_table(spark, target, kinds, ["kernel_id", "cell_index", "LOC", "ID"]).where("kernel_id IN (3, 4)")


@query(sql.cell_query("LOC", "I", "S", "ID", "OPRND"))
def written_code_metrics(spark, sf_dir):
    """The whole job: cells from Parquet, popularity, metrics written and read back."""
    target = work_dir(spark)
    view(spark, sf_dir, "code_cells").write.parquet(f"{target}/cells")
    cells = spark.read.parquet(f"{target}/cells")
    return shown(run_code_metrics(spark, cells, f"{target}/popularity", f"{target}/metrics"), "LOC", "I", "S", "ID", "OPRND")


@query(
    "SELECT doc_id AS Id, CAST(coalesce(CASE WHEN doc_id % 4 <> 0 THEN toxic END, 0) AS INT) AS advertise, CAST(quality AS INT) AS comperenension, "
    "length(text) AS size FROM documents JOIN labels USING (doc_id)"
)
def labelled_sheet_read(spark, sf_dir):
    """Labelled comments as a CSV sheet, marks missing in every fourth; a missing mark is 0."""
    target = work_dir(spark)
    rows = source_table(spark, sf_dir, "documents").join(source_table(spark, sf_dir, "labels"), "doc_id")
    write_metrics_csv(
        rows.select(
            F.col("doc_id").alias("Id"), F.col("text").alias("Text"), F.when(F.col("doc_id") % 4 != 0, F.col("toxic")).alias("advertise"),
            F.col("quality").alias("comperenension"),
        ),
        target,
    )
    return read_labelled_sheet(spark, target).select(F.col("Id").cast("bigint").alias("Id"), "advertise", "comperenension", F.length("Text").cast("bigint").alias("size"))


# -- notebook files -----------------------------------------------------------


def notebook_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as notebook JSON: the assistant writes code, the user markdown.

    System turns are markdown too, but raw cells, which are no valid kind, in
    every seventh notebook.
    """
    turns = source_table(spark, sf_dir, "conversations")
    is_raw = (F.col("role") == "system") & (F.col("conv_id") % 7 == 0)
    kind = F.when(F.col("role") == "assistant", "code").when(is_raw, "raw").otherwise("markdown")
    cell = F.struct(
        "turn",
        F.to_json(
            F.struct(
                kind.alias("cell_type"),
                F.array(F.col("text"), F.lit("\n"), F.col("role")).alias("source"),
                F.when(kind == "code", F.col("turn")).alias("execution_count"),
                F.when(kind == "code", F.array(F.struct(F.lit("display_data").alias("output_type")))).alias("outputs"),
            )
        ).alias("json"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["json"])
    body = F.concat(F.lit('{"cells": ['), F.array_join(ordered, ","), F.lit("]}"))
    return turns.groupBy(F.col("conv_id").alias("kernel_id")).agg(body.alias("content"))


TURNS = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS pos FROM conversations"
BAD_NOTEBOOKS = "SELECT DISTINCT conv_id FROM conversations WHERE role = 'system' AND conv_id % 7 = 0"


@query(
    f"WITH t AS ({TURNS}), bad AS ({BAD_NOTEBOOKS}) "
    "SELECT conv_id AS kernel_id, CAST(pos AS BIGINT) AS cell_index, CASE role WHEN 'assistant' THEN 'code' ELSE 'markdown' END AS cell_type, "
    "concat(text, chr(10), role) AS source, CASE role WHEN 'assistant' THEN 'display_data' END AS output_type, "
    "CASE role WHEN 'assistant' THEN CAST(turn AS BIGINT) END AS execution_count "
    "FROM t WHERE conv_id NOT IN (SELECT conv_id FROM bad)"
)
def notebook_file_cells(spark, sf_dir):
    parsed = nb.parse_notebooks(notebook_documents(spark, sf_dir))
    cells = nb.cells_of(nb.sound_notebooks(parsed))
    return cells.withColumns({c: F.col(c).cast("bigint") for c in ("cell_index", "execution_count")})


@query(f"SELECT conv_id AS kernel_id, 'unknown cell type' AS problem FROM ({BAD_NOTEBOOKS})")
def notebook_file_rejects(spark, sf_dir):
    return nb.rejected_notebooks(nb.parse_notebooks(notebook_documents(spark, sf_dir)))


@query(
    f"WITH t AS ({TURNS}), bad AS ({BAD_NOTEBOOKS}) SELECT conv_id AS kernel_id, "
    "coalesce(string_agg(concat(text, chr(10), role), concat(' ', chr(10), ' ') ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS code, "
    "coalesce(string_agg(concat(text, chr(10), role), concat(' ', chr(10), ' ') ORDER BY pos) FILTER (WHERE role <> 'assistant'), '') AS markdown "
    "FROM t WHERE conv_id NOT IN (SELECT conv_id FROM bad) GROUP BY conv_id"
)
def notebook_file_texts(spark, sf_dir):
    return nb.texts_of(nb.sound_notebooks(nb.parse_notebooks(notebook_documents(spark, sf_dir))))


NOTEBOOK_FILE_CELLS = (
    ("t", TURNS),
    ("bad", BAD_NOTEBOOKS),
    ("sound", "SELECT conv_id AS kernel_id, pos AS cell_index, role, concat(text, chr(10), role) AS source, "
              "CASE role WHEN 'assistant' THEN 'display_data' END AS output_type FROM t WHERE conv_id NOT IN (SELECT conv_id FROM bad)"),
    ("sound_code", "SELECT * FROM sound WHERE role = 'assistant'"),
    ("sound_md", "SELECT * FROM sound WHERE role <> 'assistant'"),
    sql.cell_metrics("sound_code", "LOC", "NVD", "OPRND", "ID", "LOCom"),
    sql.markdown_metrics("sound_md"),
    ("c", "SELECT kernel_id, sum(LOC) AS LOC, sum(NVD) AS NVD, sum(OPRND) AS OPRND, sum(ID) AS ID, sum(LOCom) AS LOCom, count(*) AS CC "
          "FROM cell_metrics GROUP BY kernel_id HAVING sum(LOC) > 1"),
    ("m", "SELECT kernel_id, count(*) AS MC, sum(MW) AS MW, sum(LMC) AS LMC FROM md_metrics GROUP BY kernel_id"),
)
FILE_METRICS = ("LOC", "NVD", "OPRND", "ID", "LOCom", "CC", "MC", "MW", "LMC")
FILE_METRICS_ORACLE = (
    sql.cte(*NOTEBOOK_FILE_CELLS)
    + "SELECT kernel_id, "
    + ", ".join(f"CAST(coalesce({n}, 0) AS BIGINT) AS {n}" for n in FILE_METRICS)
    + " FROM c FULL JOIN m USING (kernel_id)"
)


@query(FILE_METRICS_ORACLE)
def notebook_file_metrics(spark, sf_dir):
    popularity = corpus_popularity(view(spark, sf_dir, "code_cells"))
    parsed = nb.parse_notebooks(notebook_documents(spark, sf_dir))
    metrics = metrics_of_notebooks(parsed, popularity)
    return metrics.select("kernel_id", *[F.col(n).cast("bigint").alias(n) for n in FILE_METRICS])


# -- streams ------------------------------------------------------------------


CORRECTED = """WITH cells AS (
  SELECT doc_id % 50 AS kernel_id, doc_id AS cell_index,
         CASE WHEN doc_id % 7 = 0 THEN concat(text, chr(10), 'changed = 1') ELSE text END AS source, doc_id % 7 = 0 AS corrected FROM documents)
SELECT kernel_id, cell_index, corrected, CAST(length(source) - length(replace(source, chr(10), '')) + 1 AS BIGINT) AS lines FROM cells WHERE source IS NOT NULL"""


@query(CORRECTED)
def stream_corrected_cells(spark, sf_dir):
    """Cells delivered once, again the same, again in an older version, and again changed; started anew from its checkpoint for each."""
    target = work_dir(spark)
    cells = source_table(spark, sf_dir, "documents").where("text IS NOT NULL").select(
        (F.col("doc_id") % 50).alias("kernel_id"), F.col("doc_id").cast("int").alias("cell_index"), F.col("text").alias("source"),
        F.timestamp_seconds(F.col("doc_id") % 1000 + 1_700_000_000).alias("at"),
    )
    later, earlier = F.col("at") + F.expr("INTERVAL 30 MINUTES"), F.col("at") - F.expr("INTERVAL 5 MINUTES")
    changed = cells.where("cell_index % 7 = 0").withColumns({"source": F.concat("source", F.lit("\nchanged = 1")), "at": F.col("at") + F.expr("INTERVAL 60 MINUTES")})
    deliveries = [
        cells,
        cells.where("cell_index % 3 = 0").withColumn("at", later).unionByName(cells.where("cell_index % 5 = 0").withColumns({"source": F.lit("old"), "at": earlier})),
        changed,
    ]
    # The stream is started anew from its checkpoint for each delivery, however many files that has.
    for rows in deliveries:
        rows.write.mode("append").parquet(f"{target}/landed")
        stream = jobs.read_cell_stream(spark, f"{target}/landed", cells.schema)
        corrections.stream_corrections(stream, "at", f"{target}/out", f"{target}/state", keep="30 days", delay="2 hours").awaitTermination()
    versions = spark.read.parquet(f"{target}/out").groupBy("kernel_id", "cell_index").agg((F.count(F.lit(1)) > 1).alias("corrected"))
    lines = (F.length("source") - F.length(F.replace("source", F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    latest = corrections.current_cells(spark, f"{target}/out", "at").select("kernel_id", "cell_index", lines.alias("lines"))
    return latest.join(versions, ["kernel_id", "cell_index"]).select("kernel_id", F.col("cell_index").cast("bigint").alias("cell_index"), "corrected", "lines")


@query(
    sql.cte(sql.view("text_cells"), sql.cell_metrics("text_cells", "LOC", "NBD", "ID", "OPRND"))
    + "SELECT kernel_id, cell_index, LOC, round(NBD, 6) AS NBD, ID, OPRND FROM cell_metrics"
)
def stream_cell_metrics(spark, sf_dir):
    """Documents as a stream of cells, their metrics appended to a table."""
    target = work_dir(spark)
    rows = source_stream(spark, sf_dir, "documents")
    cells = rows.select(
        (F.col("doc_id") % 50).alias("kernel_id"), F.col("doc_id").alias("cell_index"), F.col("text").alias("source"),
        F.lit(None).cast("string").alias("output_type"),
    )
    jobs.stream_code_metrics(cells, None, f"{target}/metrics", f"{target}/state").awaitTermination()
    return shown(spark.read.parquet(f"{target}/metrics"), "LOC", "NBD", "ID", "OPRND")


@query(EAP_ORACLE)
def stream_cell_scores(spark, sf_dir):
    """Import scores of cells that land file by file, against the popularity of the corpus."""
    target = work_dir(spark)
    cells = view(spark, sf_dir, "code_cells")
    cells.write.parquet(f"{target}/landed")
    landed = jobs.read_cell_stream(spark, f"{target}/landed", cells.schema, files_per_batch=2)
    jobs.stream_code_metrics(landed, corpus_popularity(cells), f"{target}/metrics", f"{target}/state").awaitTermination()
    return shown(spark.read.parquet(f"{target}/metrics"), "EAP")


@query(
    "WITH c AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'import sklearn, numpy' WHEN 1 THEN 'import sklearn' ELSE concat('from m', doc_id % 5, ' import x') "
    "END AS source FROM documents), n AS (SELECT api, count(*) AS n FROM (SELECT unnest(" + sql.IMPORTS + ") AS api FROM c) GROUP BY api) "
    "SELECT api, round(n / (SELECT CAST(n AS DOUBLE) FROM n WHERE api = 'sklearn'), 6) AS score FROM n"
)
def stream_popularity(spark, sf_dir):
    """Running import counts of a stream, read back as popularity."""
    target = work_dir(spark)
    rows = source_stream(spark, sf_dir, "documents")
    last = F.concat(F.lit("from m"), (F.col("doc_id") % 5).cast("string"), F.lit(" import x"))
    source = (
        F.when(F.col("doc_id") % 3 == 0, F.lit("import sklearn, numpy"))
        .when(F.col("doc_id") % 3 == 1, F.lit("import sklearn"))
        .otherwise(last)
    )
    jobs.stream_api_counts(rows.select(source.alias("source")), f"{target}/counts", f"{target}/state").awaitTermination()
    return jobs.current_popularity(spark, f"{target}/counts").select("api", F.round("score", 6).alias("score"))


@query(sql.cte(sql.view("code_cells"), *sql.POPULARITY[:3]) + "SELECT api, round(score, 6) AS score FROM popularity")
def stream_corpus_popularity(spark, sf_dir):
    """Popularity of all imports of the code cells, counted as their files land."""
    target = work_dir(spark)
    cells = view(spark, sf_dir, "code_cells")
    cells.write.parquet(f"{target}/landed")
    landed = jobs.read_cell_stream(spark, f"{target}/landed", cells.schema, files_per_batch=2)
    jobs.stream_api_counts(landed, f"{target}/counts", f"{target}/state").awaitTermination()
    return jobs.current_popularity(spark, f"{target}/counts").select("api", F.round("score", 6).alias("score"))


@query(FILE_METRICS_ORACLE)
def stream_notebook_metrics(spark, sf_dir):
    """Notebook files that land one by one, turned into notebook metrics batch by batch."""
    target = work_dir(spark)
    documents = notebook_documents(spark, sf_dir)
    documents.write.parquet(f"{target}/landed")
    popularity = corpus_popularity(view(spark, sf_dir, "code_cells"))
    landed = spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", 4).parquet(f"{target}/landed")
    jobs.stream_notebooks(landed, popularity, f"{target}/out", f"{target}/state").awaitTermination()
    metrics = spark.read.parquet(f"{target}/out/metrics").drop("batch")
    return metrics.select("kernel_id", *[F.col(n).cast("bigint").alias(n) for n in FILE_METRICS])
