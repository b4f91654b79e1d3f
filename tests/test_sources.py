import json
import random

import pytest
from pyspark.errors import PySparkException

from nbgauge import schemas
from nbgauge.plans.cells import run_code_metrics, run_markdown_metrics
from nbgauge.plans.notebooks import metrics_of_notebooks
from nbgauge.sources import notebooks as nb
from nbgauge.sources import records, tables
from nbgauge.sources.tables import read_csv

GOOD = {
    "cells": [
        {"cell_type": "markdown", "source": ["# T\n", "x"]},
        {"cell_type": "code", "source": "import os\nx = 1", "outputs": [{"output_type": "display_data"}, {"output_type": "error"}], "execution_count": None},
        {"cell_type": "code", "source": ["a\n", "b"], "outputs": [], "execution_count": 3},
    ]
}
BAD = {
    "raw": {"cells": [{"cell_type": "raw", "source": "x"}]},
    "count": {"cells": [{"cell_type": "code", "source": "x", "outputs": []}]},
    "source": {"cells": [{"cell_type": "markdown"}]},
    "cells": {"nbformat": 4},
    "kind": {"cells": [1]},
}


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "good.ipynb").write_text(json.dumps(GOOD))
    (tmp_path / "sub" / "empty.ipynb").write_text('{"cells": []}')
    (tmp_path / "broken.ipynb").write_text("{")
    (tmp_path / "other.txt").write_text("{")
    (tmp_path / "cut.ipynb").write_text(json.dumps(GOOD)[:-1] + ', "metadata": {')
    for name, content in BAD.items():
        (tmp_path / f"{name}.ipynb").write_text(json.dumps(content))
    return str(tmp_path)


def test_notebook_files(spark, folder):
    parsed = nb.parse_notebooks(nb.read_notebook_files(spark, folder))
    cells = [tuple(r)[1:] for r in nb.cells_of(nb.sound_notebooks(parsed)).orderBy("cell_index").collect()]
    assert cells == [
        (1, "markdown", "# T\nx", None, None),
        (2, "code", "import os\nx = 1", "display_data", None),
        (3, "code", "a\nb", None, 3),
    ]
    problems = {r.path.split("/")[-1]: r.problem for r in nb.rejected_notebooks(parsed).collect()}
    assert problems == {
        "raw.ipynb": "unknown cell type", "count.ipynb": "code cell without execution_count",
        "source.ipynb": "cell without source", "cells.ipynb": "no notebook", "broken.ipynb": "no notebook",
        "cut.ipynb": "no notebook", "kind.ipynb": "no notebook",
    }
    with pytest.raises(PySparkException, match="unknown cell type|no notebook|without"):
        nb.cells_of(nb.sound_notebooks(parsed, "error")).collect()
    texts = nb.texts_of(nb.sound_notebooks(parsed)).where("code <> ''").first()
    assert (texts.code, texts.markdown) == ("import os\nx = 1 \n a\nb", "# T\nx")


def test_notebook_file_metrics(spark, folder):
    popularity = spark.createDataFrame([("os", 0.5)], schemas.API_POPULARITY)
    parsed = nb.parse_notebooks(nb.read_notebook_files(spark, folder))
    (row,) = metrics_of_notebooks(parsed, popularity).collect()
    assert (row.LOC, row.CC, row.NVD, row.EAP, row.MC, row.H1) == (4, 2, 1, 0.5, 1, 1)


def test_csv_and_jobs(spark, tmp_path):
    text = 'kernel_id,cell_index,source,output_type,execution_count\n1,1,"import sklearn\nx = ""a"", 1",display_data,1\n1,2,,,\n2,1,None,,2\n'
    (tmp_path / "code.csv").write_text(text)
    cells = tables.csv_to_parquet(spark, str(tmp_path / "code.csv"), str(tmp_path / "code"), schemas.CODE_CELLS, 2)
    rows = {(r.kernel_id, r.cell_index): r for r in tables.read_code_cells(spark, str(tmp_path / "code")).collect()}
    assert rows["1", 1].source == 'import sklearn\nx = "a", 1' and rows["1", 2].source is None and rows["2", 1].source == "None"
    words = tables.read_csv(spark, str(tmp_path / "code.csv"), schemas.CODE_CELLS, null_words=["None"])
    assert words.where("source IS NULL").count() == 2

    metrics = run_code_metrics(spark, cells, str(tmp_path / "pop"), str(tmp_path / "metrics"))
    found = {(r.kernel_id, r.cell_index): r for r in metrics.collect()}
    assert metrics.columns == list(schemas.CODE_CELL_COLUMNS)
    assert found["1", 1].EAP == 1.0 and found["1", 1].NVD == 1 and found["1", 2].LOC == 1 and found["1", 2].BLC == 0
    limited = run_code_metrics(spark, cells, str(tmp_path / "pop"), str(tmp_path / "limited"), limit_rows=2)
    assert sorted((r.kernel_id, r.cell_index) for r in limited.collect()) == [("1", 1), ("1", 2)]
    notes = run_markdown_metrics(spark, cells.select("kernel_id", "cell_index", "source"), str(tmp_path / "md"))
    assert notes.count() == 3

    tables.write_metrics_csv(metrics, str(tmp_path / "out_csv"))
    assert tables.read_csv(spark, str(tmp_path / "out_csv")).where("kernel_id = '1' AND cell_index = '1'").first().API == "sklearn"
    tables.write_metrics_json(metrics, str(tmp_path / "out_json"))
    assert spark.read.json(str(tmp_path / "out_json")).count() == 3


def test_sheet(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text("Id,Text,advertise\n1,a,1\n2,b,\n")
    assert [r.advertise for r in tables.read_labelled_sheet(spark, str(tmp_path / "sheet.csv")).orderBy("Id").collect()] == [1, 0]


def test_large_notebook(spark, tmp_path):
    """An image of 20 MB among the outputs, a text that looks like a list, a null source."""
    outputs = [{"output_type": "display_data", "data": {"image/png": "A" * (20 << 20)}}]
    cells = [
        {"cell_type": "code", "source": "[1]", "outputs": outputs, "execution_count": 1},
        {"cell_type": "code", "source": None, "outputs": {}, "execution_count": 2},
    ]
    (tmp_path / "large.ipynb").write_text(json.dumps({"cells": cells, "a": 1}))
    parsed = nb.parse_notebooks(nb.read_notebook_files(spark, str(tmp_path)))
    found = [tuple(r)[1:] for r in nb.cells_of(nb.sound_notebooks(parsed)).orderBy("cell_index").collect()]
    assert found == [(1, "code", "[1]", "display_data", 1), (2, "code", None, None, 2)]


def test_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "moved.csv").write_text('cell_index,more,source,kernel_id\n7,x,"a, b",100\noops,y,,101\n')
    rows = tables.read_csv(spark, str(tmp_path / "moved.csv"), "kernel_id BIGINT, cell_index BIGINT, source STRING").collect()
    assert [tuple(r) for r in rows] == [(100, 7, "a, b"), (101, None, None)]
    with pytest.raises(PySparkException):
        tables.read_csv(spark, str(tmp_path / "moved.csv"), "kernel_id BIGINT, absent STRING")


# -- records over splits --------------------------------------------------------

FIELDS = ["plain", "", '""', '"a, b"', '"line\nbreak"', '"win\r\nbreak"', '"say ""hi"" twice"', '"\n"', '"""\n"""', '",\n,"', 'stray"quote', '"x\n\ny"', "\u00e9\u4e16", '" "', '""""']


def quoted_file(rng, rows, end="\n"):
    return "a,b,c" + end + "".join(",".join(rng.choice(FIELDS) for _ in range(3)) + end for _ in range(rows))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [7, 16, 33, 100, 1000, 100_000])
def test_records_at_every_split_place(spark, tmp_path, size, end):
    """Splits of a few bytes, so that all kinds of places are cut; two files of several."""
    rng = random.Random(size)
    folder = tmp_path / "csv"
    folder.mkdir()
    for i in range(2):
        (folder / f"{i}.csv").write_bytes(quoted_file(rng, 40 if size < 30 else 150, end).encode())
    whole = read_csv(spark, str(folder), whole_files=True).collect()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        lines = records.text_lines(spark, str(folder))
        assert size > 1000 or lines.rdd.getNumPartitions() > 4
        found = read_csv(spark, str(folder)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted(map(repr, found)) == sorted(map(repr, whole)) and len(found) > 60


def test_record_longer_than_many_splits(spark, tmp_path):
    text = '"' + "line\n" * 500 + '"'
    (tmp_path / "long.csv").write_text(f'"a\nb",c\n1,{text}\n2,"x"\n{text},4\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", 64)
    try:
        rows = read_csv(spark, str(tmp_path / "long.csv"))
        found = {(r[0], r[1]) for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows.columns == ["a\nb", "c"] and found == {("1", "line\n" * 500), ("2", "x"), ("line\n" * 500, "4")}


def test_records_of_odd_files(spark, tmp_path):
    for i, text in enumerate(["a,b\n", "a,b", "a,b\n1,2", "a,b\n\n\n1,2\n\n", 'a,b\n1,"open\nto the end', "a,b\n1\n1,2,3\n"]):
        path = tmp_path / f"{i}.csv"
        path.write_text(text)
        same = [sorted(map(repr, read_csv(spark, str(path), whole_files=w).collect())) for w in (True, False)]
        assert same[0] == same[1], text


@pytest.mark.parametrize("line,inside,end", [
    ("a,b", False, False), ("a,b", True, True), ('a,"b', False, True), ('a,"b"', False, False), ('b",c', True, False), ('b"",c', True, True),
    ('b""",c', True, False), ('a"b,c', False, False), ('"a""', False, True), ('""', False, False), ('"', False, True), ('"', True, False), ('"x"y,"', False, True),
])
def test_where_a_line_ends(line, inside, end):
    assert records.ends_inside(line, inside) == end
