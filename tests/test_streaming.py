import json

import pytest
from pyspark.sql import functions as F

from nbgauge import schemas
from nbgauge.operators import learning
from nbgauge.operators.popularity import api_popularity, with_imports
from nbgauge.plans.cells import code_cell_metrics
from nbgauge.operators.notebook import code_notebook_metrics
from nbgauge.streaming import corrections, jobs, partials
from workloads import cells


@pytest.fixture()
def landed(spark, tmp_path):
    rows = [("k", i, f"import sklearn\nimport m{i % 3}, n\nx{i} = 1", "display_data", i) for i in range(60)]
    cells = spark.createDataFrame(rows, schemas.CODE_CELLS)
    cells.repartition(6).write.parquet(str(tmp_path / "landed"))
    return cells, str(tmp_path / "landed"), str(tmp_path)


def test_stream_equals_batch(spark, landed):
    cells, path, out = landed
    popularity = api_popularity(with_imports(cells))
    stream = jobs.read_cell_stream(spark, path, files_per_batch=2)
    jobs.stream_code_metrics(stream, popularity, f"{out}/metrics", f"{out}/state").awaitTermination()
    found = spark.read.parquet(f"{out}/metrics").drop("batch")
    expected = code_cell_metrics(cells, popularity)
    assert found.count() == 60
    assert sorted(found.collect(), key=lambda r: r.cell_index) == sorted(expected.collect(), key=lambda r: r.cell_index)
    # Started again, it only takes what is new.
    cells.limit(1).withColumn("cell_index", F.lit(99)).write.mode("append").parquet(path)
    again = jobs.read_cell_stream(spark, path, files_per_batch=2)
    jobs.stream_code_metrics(again, popularity, f"{out}/metrics", f"{out}/state").awaitTermination()
    assert spark.read.parquet(f"{out}/metrics").count() == 61


def test_stream_joins_a_large_popularity(spark, landed, monkeypatch):
    from nbgauge.operators import popularity as names

    monkeypatch.setattr(names.with_import_score, "__defaults__", (1,))
    cells, path, out = landed
    popularity = api_popularity(with_imports(cells))
    jobs.stream_code_metrics(jobs.read_cell_stream(spark, path, files_per_batch=2), popularity, f"{out}/joined", f"{out}/state4").awaitTermination()
    found = {(r.cell_index, r.EAP) for r in spark.read.parquet(f"{out}/joined").collect()}
    assert found == {(r.cell_index, r.EAP) for r in code_cell_metrics(cells, popularity).collect()}


def test_running_counts(spark, landed):
    cells, path, out = landed
    stream = jobs.read_cell_stream(spark, path, files_per_batch=2)
    jobs.stream_api_counts(stream, f"{out}/counts", f"{out}/state2").awaitTermination()
    found = {r.api: r.score for r in jobs.current_popularity(spark, f"{out}/counts").collect()}
    assert found == {r.api: r.score for r in api_popularity(with_imports(cells)).collect()}


def test_repeats(spark, landed):
    cells, path, out = landed
    cells.write.mode("append").parquet(path)
    stream = jobs.read_cell_stream(spark, path).withColumn("at", F.timestamp_seconds(F.col("execution_count") + 1_700_000_000))
    query = jobs.without_repeats(stream, "at").writeStream.format("parquet").option("path", f"{out}/once")
    query.option("checkpointLocation", f"{out}/state3").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{out}/once").count() == 60


def test_notebooks(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for i in range(5):
        cells = [{"cell_type": "code", "source": "a = 1\n" * (i + 1), "outputs": [], "execution_count": 1}]
        (folder / f"n{i}.ipynb").write_text(json.dumps({"cells": cells if i < 4 else [{"cell_type": "raw", "source": ""}]}))
    popularity = spark.createDataFrame([("os", 0.5)], schemas.API_POPULARITY)
    rows = spark.createDataFrame([(float(i), i // 5) for i in range(10)], "LOC double, label int")
    model = learning.train(rows, learning.decision_tree())
    seen = []
    stream = jobs.read_notebook_stream(spark, str(folder), files_per_batch=2)
    jobs.stream_notebooks(
        stream, popularity, str(tmp_path / "out"), str(tmp_path / "state"), model, after_batch=lambda df, i: seen.append(df.count())
    ).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/metrics")).count() == 4 == sum(seen)
    assert spark.read.parquet(str(tmp_path / "out/predictions")).count() == 4
    assert spark.read.parquet(str(tmp_path / "out/rejected")).count() == 1


# -- partials -------------------------------------------------------------------


def rounded(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


def test_partials_in_any_order_and_twice(spark, tmp_path, monkeypatch):
    """Notebooks over many batches, in two orders, the last batch run again: the metrics of all cells at once."""
    monkeypatch.setattr(partials, "FANOUT", 3)
    rows = [(str(i % 5) if i % 11 else "x1", i, f"import m{i % 3}\nif a == {i}:\n    b = f(a, {i})" if i % 4 else "x", "display_data", i) for i in range(120)]
    cells = spark.createDataFrame(rows, schemas.CODE_CELLS)
    popularity = spark.createDataFrame([("m0", 2.0), ("m1", 0.5)], "api string, score double")
    expected = rounded(code_notebook_metrics(code_cell_metrics(cells, popularity)).collect())
    parts = [cells.where(F.col("cell_index") % 11 == k) for k in range(11)]
    for order in (list(range(11)), [7, 2, 9, 0, 5, 10, 1, 3, 8, 6, 4]):
        tables = partials.PartialTables(spark, str(tmp_path / f"p{order[0]}"))
        for batch, k in enumerate(order):
            for _ in range(2 if batch in (4, 10) else 1):
                tables.compact(batch)
                tables.write(partials.code_partials(code_cell_metrics(parts[k], popularity)), batch, batch)
        found = partials.current_notebook_metrics(spark, tables.folder)
        assert found.columns == code_notebook_metrics(code_cell_metrics(cells, popularity)).columns
        assert rounded(found.collect()) == expected
        assert tables.runs() == [(0, 8), (9, 9), (10, 10)]
        # A table whose parts were not deleted, or which was not finished, changes nothing.
        tables.write(partials.code_partials(code_cell_metrics(parts[0], popularity)), 3, 5)
        (tmp_path / f"p{order[0]}" / "batches=9-10").mkdir()
        assert tables.runs() == [(0, 8), (9, 9), (10, 10)]


def test_stream_of_partials(spark, landed):
    cells, path, out = landed
    popularity = api_popularity(with_imports(cells))
    jobs_ = lambda: partials.stream_code_partials(jobs.read_cell_stream(spark, path, files_per_batch=1), popularity, f"{out}/partials", f"{out}/state9")
    jobs_().awaitTermination()
    assert rounded(partials.current_notebook_metrics(spark, f"{out}/partials", min_loc=0).collect()) == rounded(
        code_notebook_metrics(code_cell_metrics(cells, popularity), min_loc=0).collect()
    )
    more = cells.limit(5).withColumns({"cell_index": F.lit(500), "kernel_id": F.lit("7")})
    more.write.mode("append").parquet(path)
    jobs_().awaitTermination()
    both = code_cell_metrics(cells.unionByName(more), popularity)
    assert rounded(partials.current_notebook_metrics(spark, f"{out}/partials").collect()) == rounded(code_notebook_metrics(both).collect())


# -- corrections ----------------------------------------------------------------

DELIVERED = "kernel_id bigint, cell_index int, source string, at timestamp"


def deliver(spark, folder, *rows):
    made = spark.createDataFrame([(k, i, s, 1_700_000_000 + t) for k, i, s, t in rows], "kernel_id bigint, cell_index int, source string, t bigint")
    made.select("kernel_id", "cell_index", "source", F.timestamp_seconds("t").alias("at")).coalesce(1).write.mode("append").parquet(folder)


def changes(spark, out):
    rows = spark.read.parquet(f"{out}/out").collect()
    return sorted((r.kernel_id, r.cell_index, r.source, r.change) for r in rows)


def test_changed_cells_are_corrected_once(spark, tmp_path):
    """Repeats, older versions, a change, a change back, two versions in one batch; a restart from the checkpoint."""
    out = str(tmp_path)

    def run(**options):
        stream = jobs.read_cell_stream(spark, f"{out}/landed", DELIVERED, files_per_batch=1)
        corrections.stream_corrections(stream, "at", f"{out}/out", f"{out}/state", **{"keep": "10 days", "delay": "1 hour", **options}).awaitTermination()

    deliver(spark, f"{out}/landed", (1, 1, "a", 100), (1, 2, "b", 100), (1, 2000, "far", 100), (2, 1, "c", 100), (None, 1, "no id", 100))
    deliver(spark, f"{out}/landed", (1, 1, "a", 150), (1, 2, "older", 50), (2, 1, "d", 200), (2, 1, "e", 300))
    run()
    first = [(1, 1, "a", "new"), (1, 2, "b", "new"), (1, 2000, "far", "new"), (2, 1, "c", "new"), (2, 1, "d", "changed"), (2, 1, "e", "changed")]
    found = [r for r in spark.read.parquet(f"{out}/out").collect()]
    assert sorted((r.kernel_id, r.cell_index, r.source, r.change) for r in found if r.kernel_id is not None) == first
    # Known from before the restart: the same, one from before the change, and a change back.
    deliver(spark, f"{out}/landed", (1, 1, "a", 400), (2, 1, "d", 250), (2, 1, "c", 500), (1, 2, None, 600))
    run()
    found = sorted((r.kernel_id, r.cell_index, str(r.source), r.change) for r in spark.read.parquet(f"{out}/out").collect() if r.kernel_id is not None)
    assert found == sorted([*first, (2, 1, "c", "changed"), (1, 2, "None", "changed")])
    latest = {(r.kernel_id, r.cell_index): r.source for r in corrections.current_cells(spark, f"{out}/out", "at").collect()}
    assert latest == {(1, 1): "a", (1, 2): None, (1, 2000): "far", (2, 1): "c", (None, 1): "no id"}


def test_versions_are_let_go(spark, tmp_path):
    """Once the stream is ``keep`` past a cell it is new again; rows behind the watermark are dropped."""
    out = str(tmp_path)
    hour = 3600
    for rows in ([(1, 1, "a", 0), (1, 2, "b", 3 * hour)], [(9, 9, "moves time on", 10 * hour)], [(9, 9, "again", 11 * hour)], [(1, 1, "a", 12 * hour), (1, 2, "late", 2 * hour)]):
        deliver(spark, f"{out}/landed", *rows)
        stream = jobs.read_cell_stream(spark, f"{out}/landed", DELIVERED, files_per_batch=1)
        corrections.stream_corrections(stream, "at", f"{out}/out", f"{out}/state", keep="4 hours", delay="1 hour").awaitTermination()
    assert [c for c in changes(spark, out) if c[0] == 1] == [(1, 1, "a", "new"), (1, 1, "a", "new"), (1, 2, "b", "new")]


@pytest.mark.parametrize("files", [0, 3])
def test_queries_on_a_table_of_one_or_many_files(spark, tmp_path, files):
    rows = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("x = 1\n").alias("text"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    if files:
        rows.repartition(files).write.parquet(str(tmp_path / "documents.parquet"))
    else:
        next((tmp_path / "one").glob("part-*")).rename(tmp_path / "documents.parquet")
    (tmp_path / "documents.parquet.old").mkdir()
    assert cells.stream_cell_metrics(spark, str(tmp_path)).count() == 30
    found = {r.api: r.score for r in cells.stream_popularity(spark, str(tmp_path)).collect()}
    assert found == {"sklearn": 1.0, "numpy": 0.5, **{f"m{i}": 0.1 for i in range(5)}}


def test_popularity_is_worked_out_once(spark, landed):
    cells, path, out = landed
    asked = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            asked.add(batch.num_rows)
            yield batch

    popularity = spark.createDataFrame([("sklearn", 1.0), ("n", 0.5)], schemas.API_POPULARITY).coalesce(1).mapInArrow(counted, schemas.API_POPULARITY)
    for run in (jobs.stream_code_metrics, partials.stream_code_partials):
        name = run.__name__
        run(jobs.read_cell_stream(spark, path, files_per_batch=2), popularity, f"{out}/{name}", f"{out}/{name}-state").awaitTermination()
    assert asked.value == 2 * 2


def test_batches_of_few_files_are_spread(spark):
    few, many = spark.range(0, 30, 1, 1), spark.range(0, 30, 1, 8)
    assert jobs.spread(few, rows=10).rdd.getNumPartitions() == 3
    assert jobs.spread(few, rows=1).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert jobs.spread(few) is few and jobs.spread(many, rows=1) is many


def test_deliveries_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "work_dir", lambda spark: str(tmp_path / "work"))
    rows = spark.range(210).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    rows.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(cells, "source_table", lambda spark, folder, name: rows.repartition(4))
    found = {r.cell_index: (r.corrected, r.lines) for r in cells.stream_corrected_cells(spark, str(tmp_path)).collect()}
    assert found == {i: (i % 7 == 0, 1 + (i % 7 == 0)) for i in range(210)}
    # Four files of cells, eight of repeats and old versions, four of changes.
    assert len(list((tmp_path / "work/landed").glob("part-*"))) == 16
