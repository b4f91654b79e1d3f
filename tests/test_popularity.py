import os
import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException

from nbgauge.operators.popularity import api_counts, api_popularity, join_import_score, with_import_score, with_imports
from nbgauge.plans import popularity as plan
from nbgauge.plans.popularity import updated_popularity

SOURCES = [
    (1, 1, "import sklearn\nimport numpy, pandas"),
    (1, 2, "import sklearn"),
    (2, 1, "import numpy\nimport numpy"),
    (2, 1, "import numpy\nimport numpy"),
    (2, 2, "x = 1"),
    (3, 1, "import torch"),
    (None, 1, None),
]


@pytest.fixture()
def cells(spark):
    return with_imports(spark.createDataFrame(SOURCES, "kernel_id int, cell_index int, source string"))


def test_counts_and_shares(cells):
    assert {r.api: r.n for r in api_counts(cells).collect()} == {"sklearn": 2, "numpy": 5, "pandas": 1, "torch": 1}
    assert {r.api: r.score for r in api_popularity(cells).collect()} == {
        "sklearn": 1.0, "numpy": 2.5, "pandas": 0.5, "torch": 0.5,
    }


def test_missing_baseline(cells):
    with pytest.raises(PySparkException, match="baseline jax"):
        api_popularity(cells, "jax").collect()


@pytest.mark.parametrize("score", [with_import_score, join_import_score, lambda c, p: with_import_score(c, p, 2)])
def test_scores(cells, score):
    # One name is unknown to the table.
    popularity = api_popularity(cells).where("api <> 'torch'")
    found = [(r.kernel_id, r.cell_index, r.EAP) for r in score(cells, popularity).collect()]
    expected = [(1, 1, 4.0), (1, 2, 1.0), (2, 1, 2.5), (2, 1, 2.5), (2, 2, 0.0), (3, 1, 0.0), (None, 1, 0.0)]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_saved_table_knows_its_corpus(spark, tmp_path):
    def corpus(name, *imports):
        rows = [(1, i, f"import {x}") for i, x in enumerate(imports)]
        spark.createDataFrame(rows, "kernel_id bigint, cell_index int, source string").write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    def scores(cells, **options):
        return {r.api: r.score for r in updated_popularity(spark, cells, str(tmp_path / "table"), **options).collect()}

    one, two = corpus("one", "sklearn", "sklearn", "os"), corpus("two", "sklearn", "os", "os")
    assert scores(one) == {"sklearn": 1.0, "os": 0.5}
    written = sorted(p.name for p in (tmp_path / "table").iterdir())
    assert scores(one) == {"sklearn": 1.0, "os": 0.5} and written == sorted(p.name for p in (tmp_path / "table").iterdir())
    assert scores(two) == {"sklearn": 1.0, "os": 2.0}
    assert scores(two, baseline="os") == {"sklearn": 0.5, "os": 1.0}


def test_hot_list_join_keeps_all_rows(spark):
    """A third of the cells share one import list."""
    cells = spark.range(3000).selectExpr(
        "id % 7 AS kernel_id", "CAST(id AS INT) AS cell_index",
        "CASE id % 3 WHEN 0 THEN 'import numpy' WHEN 1 THEN 'y' ELSE concat('import m', id) END AS source",
    )
    cells = with_imports(cells)
    popularity = spark.createDataFrame([("numpy", 2.0), ("m5", 3.0)], "api string, score double")
    scored = join_import_score(cells, popularity)
    assert scored.count() == 3000
    assert scored.agg({"EAP": "sum"}).first()[0] == 2003.0


def write_cells(spark, path, *imports):
    """One Parquet file of that very name."""
    rows = [(1, i, f"import {x}") for i, x in enumerate(imports)]
    folder = f"{path}-folder"
    spark.createDataFrame(rows, "kernel_id bigint, cell_index int, source string").coalesce(1).write.mode("overwrite").parquet(folder)
    (found,) = [f for f in os.listdir(folder) if f.startswith("part-")]
    os.makedirs(os.path.dirname(path), exist_ok=True)
    shutil.copy(os.path.join(folder, found), path)


def counted_files(folder):
    """Files by the generation that counted them."""
    out = {}
    for name in os.listdir(f"{folder}-parts/counts"):
        out[name] = {f.rsplit("/", 1)[-1] for f in pq.read_table(f"{folder}-parts/counts/{name}")["file"].to_pylist()}
    return out


def test_popularity_follows_its_files(spark, tmp_path, monkeypatch):
    corpus, table = str(tmp_path / "corpus"), str(tmp_path / "table")
    put = lambda name, *imports: write_cells(spark, f"{corpus}/{name}.parquet", *imports)

    def scores(**options):
        return {r.api: r.score for r in updated_popularity(spark, spark.read.parquet(corpus), table, **options).collect()}

    put("a", "sklearn", "os")
    put("b", "sklearn", "torch", "torch")
    assert scores() == {"sklearn": 1.0, "os": 0.5, "torch": 1.0}
    # Nothing changed: nothing is written.
    before = {p: os.stat(f"{table}/{p}").st_mtime_ns for p in os.listdir(table)}
    assert scores() == {"sklearn": 1.0, "os": 0.5, "torch": 1.0} and before == {p: os.stat(f"{table}/{p}").st_mtime_ns for p in os.listdir(table)}
    # A new file: only that one is read.  The others are made unreadable without a trace.
    put("c", "os", "os", "os")
    kept = {}
    for name in ("a", "b"):
        path = f"{corpus}/{name}.parquet"
        kept[name], stat = open(path, "rb").read(), os.stat(path)
        data = bytearray(kept[name])
        column = pq.ParquetFile(path).metadata.row_group(0).column(2)
        start = column.dictionary_page_offset or column.data_page_offset
        data[start : start + 12] = b"x" * 12
        with open(path, "r+b") as f:
            f.write(bytes(data))
        os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    with pytest.raises(Exception, match="reading file"):
        spark.read.parquet(corpus).select("source").collect()
    assert scores() == {"sklearn": 1.0, "os": 2.0, "torch": 1.0}
    assert counted_files(table) == {"generation=1": {"a.parquet", "b.parquet"}, "generation=2": {"c.parquet"}}
    for name, data in kept.items():
        stat = os.stat(f"{corpus}/{name}.parquet")
        with open(f"{corpus}/{name}.parquet", "r+b") as f:
            f.write(data)
        os.utime(f"{corpus}/{name}.parquet", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    # Rewritten in place under its name, and one file gone.
    put("b", "sklearn", "sklearn", "jax")
    os.remove(f"{corpus}/c.parquet")
    assert scores() == {"sklearn": 1.0, "os": 1 / 3, "jax": 1 / 3}
    assert counted_files(table) == {"generation=1": {"a.parquet", "b.parquet"}, "generation=3": {"b.parquet"}}
    # Another baseline divides anew, counts stay; names read in another way are counted anew.
    assert scores(baseline="os") == {"sklearn": 3.0, "os": 1.0, "jax": 1.0} and len(counted_files(table)) == 2
    assert scores(strict=False) == {"sklearn": 1.0, "os": 1 / 3, "jax": 1 / 3} and len(counted_files(table)) == 1
    # Many generations become one.
    monkeypatch.setattr(plan, "GENERATIONS", 2)
    for i, name in enumerate("def"):
        put(name, "sklearn", name * 3)
        assert scores(strict=False) == {r: n for r, n in scores(strict=False).items()}
    assert scores(strict=False)["sklearn"] == 1.0 and scores(strict=False)["ddd"] == 1 / 6
    assert len(counted_files(table)) <= 2
    # An update that broke off is made again.
    put("g", "sklearn", "os")
    last = max(plan._numbers(spark, f"{table}-parts", "v"))
    os.makedirs(f"{table}-parts/v{last + 1}")
    assert scores(strict=False)["os"] == 2 / 7


def test_popularity_of_a_table_without_files(spark, tmp_path):
    rows = spark.range(4).selectExpr("id AS kernel_id", "1 AS cell_index", "IF(id < 3, 'import sklearn', 'import os') AS source")
    for cells in (rows, rows.union(rows)):
        assert {r.api: r.score for r in updated_popularity(spark, cells, str(tmp_path / "table")).collect()} == {"sklearn": 1.0, "os": 1 / 3}
