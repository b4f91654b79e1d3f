import random

import pytest

from nbgauge import schemas
from nbgauge.functions.complexity import cell_complexity
from nbgauge.plans.cells import code_cell_metrics, markdown_cell_metrics
from nbgauge.operators.popularity import with_imports
from tests import cell_rules

CODE = [
    ("", dict(LOC=1, BLC=0, ALLC=0, NBD=0, ID=0, ALID=0, MLID=0, OPRND=0, P=0, CW=0, API=[], KLCID=0)),
    ("a==b", dict(OPRATOR=3, UOPRATOR=2, OPRND=2, UOPRND=2, ID=2, KLCID=2.0)),
    ("import a, b\nimport c, d", dict(I=2, API=["c, d", "a", "b"])),
    ("import numpy as np, pandas as pd", dict(API=["numpy"])),
    ("import os.path\nfrom x.y import z", dict(API=["os", "x"])),
    ("f()", dict(P=1, ID=1)),
    ("f(a,\nb)", dict(P=0)),
    ("f(x)\ng(a,\nb)", dict(P=0)),
    ("f(a,\ng(b, c)", dict(P=2)),
    ("f(\n    **kw)!=1", dict(OPRND=3)),
    ("elif format", dict(S=2)),
    ("  # def x", dict(UDF=1)),
    ("# def x", dict(UDF=0, LOCom=1, CW=2)),
    ("undef x\ndef f(): pass", dict(UDF=2)),
    ("x = '#'", dict(LOCom=1, CW=1)),
    ("x = 1 #", dict(LOCom=0, CW=0)),
    ("'''a\nb'''\ny", dict(LOCom=2)),
    ('"""a\n\nb"""', dict(LOCom=3)),
    ("abc abcde", dict(ALID=4, MLID=5)),
    ("ab abc", dict(ALID=2)),
    ("9abc True x_1", dict(ID=2, MLID=3)),
    ("a\nb\na\n\n1", dict(LOC=5, KLCID=1.0)),
    ("é\r\nü", dict(LOC=2, ALLC=1.5, ID=0)),
    ("a\u2028# b c", dict(LOC=1, CW=2, LOCom=1)),
    ("try:\n  pass\nexcept E:\n  pass\n", dict(LOC=5, EH=1, NBD=1.0)),
    ("a not in b and c is not d", dict(OPRATOR=7, UOPRATOR=6)),
    ("!pip install x", dict(CyC=0)),
    ("%matplotlib inline", dict(CyC=1)),
    ("x = 1", dict(CyC=1)),
    ("if a and b:\n    x = 1", dict(CyC=3)),
]


def run_code(spark, texts, output=None):
    rows = [("k", i, t, output, None) for i, t in enumerate(texts)]
    cells = spark.createDataFrame(rows, schemas.CODE_CELLS)
    return [r.asDict() for r in code_cell_metrics(cells).orderBy("cell_index").collect()]


def test_code_fixtures(spark):
    found = run_code(spark, [t for t, _ in CODE])
    for (text, expected), row in zip(CODE, found):
        assert {k: row[k] for k in expected} == expected, text


def test_null_cell(spark):
    cells = spark.createDataFrame([("k", 1, None, None, None)], schemas.CODE_CELLS)
    raw = code_cell_metrics(cells, fill_null=False).first()
    assert (raw.LOC, raw.BLC, raw.ALLC, raw.OPRND, raw.ID) == (0, 1, 0, 0, 0)
    filled = code_cell_metrics(cells).first()
    assert (filled.LOC, filled.BLC, filled.NVD) == (1, 0, 0)


def test_outputs(spark):
    (row,) = run_code(spark, ["x"], "display_data execute_result display_data")
    assert (row["NVD"], row["NEC"]) == (2, 1)


def test_import_options(spark):
    cells = spark.createDataFrame([("import a, b\nimport c,\td\nimport e",)], "source string")
    assert with_imports(cells, strict=False).first().API == ["a", "b", "c", "d", "e"]
    assert with_imports(cells).first().API == ["c,\td", "e", "a", "b"]


PIECES = list("a_1 #'\"=!*/<>()\n\t,.%é\x1c\r") + [
    "import ", "from ", "def ", "'''", '"""', "\n    ", " and ", " not in ", "for", "try:", "b, c", "f(", ">>=", "//=", "True",
    "# ", "## ", "### ", "\n",
]


def random_texts(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choices(PIECES, k=draw.randint(0, 40))) for _ in range(n)]


def test_code_against_rules(spark):
    texts = random_texts(1500, 7)
    for text, row in zip(texts, run_code(spark, texts)):
        expected = cell_rules.code_metrics(text)
        got = {k: row[k] for k in expected}
        assert _same(got, expected), repr(text)


def _same(got, expected):
    for name, value in expected.items():
        if isinstance(value, float):
            assert got[name] == pytest.approx(value), name
        else:
            assert got[name] == value, name
    return True


def test_properties(spark):
    for row in run_code(spark, random_texts(500, 11)):
        assert row["UOPRND"] <= row["OPRND"] and row["UOPRATOR"] <= 39
        assert row["MLID"] >= row["ALID"] and row["LOC"] >= 1
        assert row["ID"] > 0 or row["ALID"] == row["MLID"] == 0


MARKDOWN = [
    ("# T", dict(H1=1, H2=0, H3=0, LMC=1, MW=2)),
    (" # # ", dict(H1=2, MW=2)),
    ("## A\n### B", dict(H1=0, H2=1, H3=1, LMC=2, MW=4)),
    ("", dict(LMC=1, MW=0)),
    ("a\u00a0b\x1cc\u3000d", dict(MW=4)),
]


def run_markdown(spark, texts):
    cells = spark.createDataFrame([("k", i, t) for i, t in enumerate(texts)], schemas.MARKDOWN_CELLS)
    return [r.asDict() for r in markdown_cell_metrics(cells).orderBy("cell_index").collect()]


def test_markdown_fixtures(spark):
    for (text, expected), row in zip(MARKDOWN, run_markdown(spark, [t for t, _ in MARKDOWN])):
        assert {k: row[k] for k in expected} == expected, text


def test_markdown_against_rules(spark):
    texts = random_texts(1500, 3)
    for text, row in zip(texts, run_markdown(spark, texts)):
        assert _same(row, cell_rules.markdown_metrics(text)), repr(text)


def test_long_cells_stay_fast(spark):
    n = 200_000
    texts = ["a1" * n, "f(" * n, "\n" * n, "import " + "a, " * n + "b", " and" * n, "((" * n, "x = '" + "9f" * n + "'"]
    found = run_code(spark, texts)
    assert [r["LOC"] for r in found] == [1, 1, n + 1, 1, 1, 1, 1]
    assert found[1]["P"] == 0 and len(found[3]["API"]) == n + 1


def test_complexity_rules():
    cases = {
        "for x in y:\n    pass\nelse:\n    pass": 3,
        "while a or b or c:\n    pass": 4,
        "try:\n    pass\nexcept A:\n    pass\nexcept B:\n    pass\nelse:\n    pass\nfinally:\n    pass": 4,
        "[x for x in y if x if z]": 4,
        "assert a and b": 2,
        "x = 1 if a else 2": 2,
        "def f():\n    if a:\n        pass": 1,
        "class A:\n    x = 1 if a else 2": 1,
        "match x:\n    case 1:\n        pass\n    case _:\n        pass": 2,
        "with a:\n    if b:\n        pass": 2,
        "lambda: a and b": 2,
        "print 1": 0,
        "": 1,
    }
    for source, expected in cases.items():
        assert cell_complexity(source) == expected, source


def test_lines_are_searched_once_for_their_identifiers(spark):
    from pyspark.sql import functions as F

    from nbgauge.functions.code import identifiers_per_line

    df = spark.createDataFrame([("a = b\n\na = b\nfor c in d:\n    1",), (None,), ("1\n2",)], "source string").select(identifiers_per_line(F.col("source")).alias("n"))
    assert [r["n"] for r in df.collect()] == [2.0, 0.0, 0.0]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 1


def test_sound_sources_without_branches_need_no_tree(monkeypatch):
    from nbgauge.functions import complexity

    whole = {s: complexity.cell_complexity(s) for s in ("return 1", "def f(a, a): pass", "x = 1\nglobal x", "x = (", "a\0b")}
    assert whole == {"return 1": 1.0, "def f(a, a): pass": 1.0, "x = 1\nglobal x": 1.0, "x = (": 0.0, "a\0b": 0.0}
    monkeypatch.setattr(complexity.ast, "parse", None)
    assert complexity.cell_complexity("%matplotlib inline\nx = f(1)\n\ndef g():\n    return x") == 1.0


def test_branches_told_by_words_need_no_tree(monkeypatch):
    import random

    from nbgauge.functions import complexity

    parts = (
        "if a and b or c:\n    d\n", "elif e:\n    f\n", "for x in y:\n    z\n", "while a:\n    b\n", "else:\n    c\n", "try:\n    d\nexcept E:\n    f\n",
        "try:\n    d\nexcept* E:\n    f\n", "[a for b in c if d if e]\n", "f = a if b else c\n", "# if and for\n", "x = 'if a and b'\n", "g = f'{a and b}'\n",
        "def h():\n    if a:\n        b\n", "assert a or b\n", "x = 1or 2\n", "x = 0xfor 2\n", "é = a and b\n", "a\rif b: c\n", "match x:\n    case 1 if a:\n        b\n",
        "lambda: a and (b or c)\n", "if a: b\\\n\n", "v = elif_ = x.android\n", "async def i(): pass\n", "with a: b\n", ")", "if\n",
    )
    draw = random.Random(3)
    sources = [*parts, *["".join(draw.choices(parts, k=draw.randint(1, 4))) for _ in range(3000)]]
    short = [complexity.cell_complexity(s) for s in sources]
    monkeypatch.setattr(complexity, "_SHORT", -1)
    assert short == [complexity.cell_complexity(s) for s in sources] and len(set(short)) > 5
    monkeypatch.undo()
    monkeypatch.setattr(complexity.ast, "parse", None)
    assert complexity.cell_complexity("try:\n    for i in range(3):  # and so on\n        h(i)\nexcept ValueError:\n    pass") == 3.0


def test_no_pattern_is_compiled_for_a_cell(spark):
    from pyspark.sql import functions as F

    from nbgauge.functions.code import operand_pieces, parameters

    source = F.col("source")
    texts = ["a!=b", "a!==b", "!!=", "a\n    **b", "a\n    ==b\n    c", "f(a,\n g(b, c)", "f(a,\n b)", "f()", "f(a, b) + g(c)", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, source string").select("i", operand_pieces(source).alias("o"), parameters(source).alias("p"))
    found = [(r["o"], r["p"]) for r in df.orderBy("i").collect()]
    assert [o for o, _ in found][:5] == [["a", "b"], ["a", "b"], ["!"], ["a", "b"], ["a", "b\n    c"]]
    assert [p for _, p in found] == [0, 0, 0, 0, 0, 2, 0, 1, 3, 0]
    # split() takes its pattern as text and compiles it for each row, unless it is one plain character.
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "-1)" in plan and "==), -1)" not in plan
