from pyspark.sql import functions as F

from nbgauge import schemas
from nbgauge.operators.notebook import (
    apply_filters, clean_cell_index, code_notebook_metrics, drop_repeated_cells, join_author_tier, join_notebook_metrics,
    markdown_notebook_metrics, prepare_author_tier,
)
from nbgauge.operators.cleaning import one_row_per_key
from nbgauge.operators.texts import assemble_texts, text_pairs
from nbgauge.plans.notebooks import notebook_metrics


def code(spark, rows):
    cells = spark.createDataFrame(rows, "kernel_id string, LOC bigint, ID bigint, NBD double")
    missing = [c for c in schemas.CODE_CELL_COLUMNS if c not in (*cells.columns, "API", "cell_index")]
    return cells.withColumns({c: F.lit(1) for c in missing})


def markdown(spark, rows):
    cells = spark.createDataFrame(rows, "kernel_id string, MW bigint, LMC bigint")
    return cells.withColumns({c: F.lit(0) for c in ("H1", "H2", "H3")})


ROWS = [("7", 2, 3, 0.5), ("7", 4, 5, 1.5), ("8", 1, 1, 0.0), ("train_emb", 9, 9, 0.0), ("12.0", 5, 1, 0.0), ("10", 3, 0, 0.0), (None, 9, 9, 0.0)]
NOTES = [("7", 2, 1), ("7", 5, 2), ("9", 1, 1)]


def by_id(df):
    return {r.kernel_id: r for r in df.collect()}


def test_notebook_metrics(spark):
    left = notebook_metrics(code(spark, ROWS), markdown(spark, NOTES))
    assert left.columns == ["kernel_id", *schemas.NOTEBOOK_METRICS] and len(schemas.NOTEBOOK_METRICS) == 34
    rows = by_id(left)
    assert set(rows) == {7, 10, 0}
    seven = rows[7]
    assert (seven.LOC, seven.MeanLCC, seven.ID, seven.AID, seven.CC, seven.NBD) == (6, 3.0, 8, 5, 2, 1.5)
    assert (seven.MC, seven.MeanWMC, seven.MW) == (2, 3.5, 7)
    assert (rows[10].MC, rows[10].MW) == (0, 0)
    full = by_id(notebook_metrics(code(spark, ROWS), markdown(spark, NOTES), how="full"))
    assert set(full) == {7, 10, 0, 9} and (full[9].LOC, full[9].MC) == (0, 1)
    dropped = by_id(code_notebook_metrics(code(spark, ROWS), drop_bad_ids=True))
    assert set(dropped) == {7, 10}


def test_junk_ids_do_not_multiply(spark):
    junk = code(spark, [(f"junk{i}", 5, 1, 0.0) for i in range(3)] + [("7", 2, 3, 0.5)])
    notes = markdown(spark, [(f"note{i}", i, 1) for i in range(4)] + [("7", 2, 1)])
    rows = sorted((r.kernel_id, r.LOC, r.MC, r.MW) for r in notebook_metrics(junk, notes).collect())
    assert rows == [(0, 5, 4, 6)] * 3 + [(7, 2, 1, 2)]
    assert [r.kernel_id for r in notebook_metrics(junk, notes, how="full", drop_bad_ids=True).collect()] == [7]


def test_sums_equal_cells(spark):
    cells = code(spark, [(str(i % 5), i, i % 3, 0.1) for i in range(200)])
    total = code_notebook_metrics(cells).agg(F.sum("LOC"), F.sum("CC"), F.sum("ID")).first()
    assert tuple(total) == (sum(range(200)), 200, sum(i % 3 for i in range(200)))
    again = code_notebook_metrics(cells.repartition(3, "LOC"))
    assert sorted(again.collect()) == sorted(code_notebook_metrics(cells).collect())


def test_typed_ids_join_without_another_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = code_notebook_metrics(code(spark, ROWS).withColumn("kernel_id", F.col("kernel_id").try_cast("bigint")))
        right = markdown_notebook_metrics(markdown(spark, NOTES).withColumn("kernel_id", F.col("kernel_id").cast("bigint")))
        plan = join_notebook_metrics(left, right)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") == 2


def test_author_tier(spark):
    tiers = spark.createDataFrame([(0, 7, 3)], "`Unnamed: 0` int, Id_x bigint, PerformanceTier int")
    rows = by_id(join_author_tier(notebook_metrics(code(spark, ROWS), markdown(spark, NOTES)), prepare_author_tier(tiers)))
    assert (rows[7].PT, rows[10].PT) == (3, 0)


def test_cell_index_and_repeats(spark):
    cells = spark.createDataFrame([("a", "1.0"), ("a", "x"), ("train_emb", "2"), (None, "3")], "kernel_id string, cell_index string")
    assert sorted(r.cell_index for r in clean_cell_index(cells).collect()) == [0, 1, 3]
    assert drop_repeated_cells(cells.unionByName(cells)).count() == 4
    sources = spark.createDataFrame([("a", 1, "y"), ("a", 1, "x"), (None, 2, None)], "kernel_id string, cell_index int, source string")
    kept = drop_repeated_cells(sources)
    assert kept.columns == sources.columns and {tuple(r) for r in kept.collect()} == {("a", 1, "x"), (None, 2, None)}


def test_filters_and_one_row(spark):
    rows = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (2, None, "c")], "kernel_id int, LOC int, t string")
    assert apply_filters(rows, ["LOC < 10", "t = 'a'"]).count() == 1
    assert sorted(tuple(r) for r in one_row_per_key(rows).collect()) == [(1, 5, "a"), (2, None, "c")]


def test_texts(spark):
    cells = spark.createDataFrame(
        [(1, 3, "code", "c"), (1, 1, "code", "a"), (1, 2, "markdown", "m" * 400), (1, 25, "code", "z"), (2, 1, "raw", "r")],
        "kernel_id int, cell_index int, cell_type string, source string",
    )
    far = spark.createDataFrame([(3, 1, "code", "first"), (3, 10_001, "code", "last"), (None, 1, "code", "lost")], cells.schema)
    rows = assemble_texts(cells.unionByName(far)).collect()
    assert {r.kernel_id: r.code for r in rows} == {1: "a \n c \n z", 2: "", 3: "first \n last"} and len(rows) == 3
    pair = text_pairs(assemble_texts(cells)).where("kernel_id = 1").first()
    assert len(pair.markdown) == 300 and pair.text == pair.markdown + "\n" + pair.code


def test_one_pass_equals_join(spark):
    from nbgauge.plans.cells import code_cell_metrics, markdown_cell_metrics, mixed_cell_metrics
    from nbgauge.operators.notebook import mixed_notebook_metrics

    rows = [
        (1, 1, "code", "import os\nx = 1 if y else 2", "display_data"), (1, 2, "markdown", "# T\na", None), (2, 1, "code", "x", None),
        (2, 2, "markdown", "## b", None), (3, 1, "markdown", "c d", None), (4, 1, "code", "a\nb", None), (5, 1, "code", "z", None),
        (None, 1, "code", "a\nb", None),
    ]
    cells = spark.createDataFrame(rows, "kernel_id bigint, cell_index int, cell_type string, source string, output_type string")
    popularity = spark.createDataFrame([("os", 0.5)], schemas.API_POPULARITY)
    joined = notebook_metrics(
        code_cell_metrics(cells.where("cell_type = 'code'"), popularity), markdown_cell_metrics(cells.where("cell_type = 'markdown'")), how="full"
    )
    single = mixed_notebook_metrics(mixed_cell_metrics(cells, popularity))
    assert single.columns == joined.columns
    assert [tuple(r) for r in single.orderBy("kernel_id").collect()] == [tuple(r) for r in joined.orderBy("kernel_id").collect()]


def test_functions_compose(spark):
    from nbgauge import functions as metrics

    row = spark.createDataFrame([("f(a, b)\nx == y",)], "s string").select(
        metrics.parameters(F.col("s")).alias("p"), metrics.operators(F.col("s")).alias("o"),
        metrics.unique_operators(F.col("s")).alias("u"), metrics.identifiers(F.col("s")).alias("i"),
        metrics.mean_identifier_length(F.col("s")).alias("a"), metrics.unique_operands(F.col("s")).alias("n"),
        metrics.headers(F.col("s"), 1).alias("h"),
    ).first()
    assert tuple(row) == (2, 3, 2, 5, 1, 4, 0)
