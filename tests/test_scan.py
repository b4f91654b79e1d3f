"""The scan of many cells at once against the functions of one cell."""

import ast
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nbgauge.functions import code as C
from nbgauge.functions import scan as S
from nbgauge.functions.complexity import cell_complexity, complexities
from nbgauge.functions.grammar import surely_parse

PIECES = [
    "import ", "import a, b", "from os.path import join", "def ", "def f(x):", "try:", "while", "for", "if ", "elif x:", "except", "except *", " and ",
    " or ", " not ", " is ", " is not ", " in ", " not in ", "and ", "in ", "**", "*", "//", "/", "=", "==", "===", "!=", "!", "!==", "+=", "**=", ">>=",
    "<<", "<", "(", ")", "f(", "9f(", "99(", "a.b(", ",", "\n", "\n", "\n    ", "\n    **", "\n     //=", "\t", " ", "  ", "#", "# note", "##", "#\n", "'''", '"',
    "x", "x1", "1x", "12", "1_0", "_", "True", "value_f", "abcdefgh", "abcdefghi", "x = 1", "x = 1\n", "\\", "é", "\r", "\x0c", "%matplotlib inline", "{", ":", ";",
    "match", "case", "assert x", "else", "pass", "[", "]", ".", "lambda", "print",
]


def made(n: int, seed: int) -> list[str]:
    draw = random.Random(seed)
    return [draw.choice(["", "", "# head\n"]) + "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 14))) for _ in range(n)]


def test_scan_agrees_with_the_functions_of_one_cell(spark):
    texts = [*made(3000, 1), "", None, "a" * (S.LONG + 1), "\n\n", "f(a,\n b(c, d)\n)", "f(a,\n b)", "x = 1\nx = 1\ny = 2", "a-b-a-ab"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, source string").repartition(2)
    source = F.col("source")
    expected = {
        "LOC": C.lines_of_code, "UDF": C.function_definitions, "I": C.import_statements, "EH": C.exception_handlers, "ALLC": C.mean_line_length, "S": C.statements,
        "P": C.parameters, "KLCID": C.identifiers_per_line, "NBD": C.nested_block_depth, "OPRATOR": C.operators, "OPRND": C.operands, "UOPRND": C.unique_operands,
        "UOPRATOR": C.unique_operators, "ID": C.identifiers, "ALID": C.mean_identifier_length, "MLID": C.max_identifier_length, "CW": C.comment_words,
    }
    both = rows.select("source", S.scan_of(source).alias("s"), *[f(source).alias(f"_{m}") for m, f in expected.items()], (C.comment_lines(source) - C.block_lines(source)).alias("_hash_lines"))
    found = both.collect()
    taken = [r for r in found if r["s"] is not None]
    assert len(taken) > 1500
    for r in taken:
        for m in (*expected, "hash_lines"):
            assert r["s"][m] == pytest.approx(r[f"_{m}"], abs=1e-12), (m, r["source"])
    left = {r["source"] for r in found if r["s"] is None}
    assert None in left and "a" * (S.LONG + 1) in left
    assert all(c is None or len(c) > S.LONG or not c.isascii() or set(c) & set("\r\x0c") or "\n    " in c for c in left)


def test_texts_with_equal_hashes_are_compared(monkeypatch):
    """Hashes that say nothing leave the cells to the patterns; they never make different texts one."""
    texts = pa.array(["a=b", "a=a", "ab=a"])
    assert [r["UOPRND"] for r in S.scan(texts).to_pylist()] == [2, 1, 2]
    monkeypatch.setattr(S.Cells, "hashes", lambda self, first, end: first.astype("uint64") * 0)
    assert [r and r["UOPRND"] for r in S.scan(texts).to_pylist()] == [None, 1, 2]


def test_cells_are_cut_into_runs(monkeypatch):
    texts = pa.array(made(200, 2))
    whole = S.scan(texts).to_pylist()
    monkeypatch.setattr(S, "TOGETHER", 100)
    assert S.scan(texts).to_pylist() == whole
    assert S.scan(texts.slice(50, 20)).to_pylist() == whole[50:70]
    assert S.scan(texts.slice(0, 0)).to_pylist() == []


def by_tree(source: str) -> bool:
    try:
        ast.parse(source.replace("%matplotlib inline", ""))
    except (SyntaxError, ValueError):
        return False
    return True


def test_complexity_of_a_batch_is_that_of_each_cell(recwarn):
    draw = random.Random(3)
    lines = ["if a and b:", "    x = 1", "for i in y:", "# if and or", "    pass", "x = 1 # for", "try:", "except ValueError:", "except * A:", "    f(a, b or c)", "x = 1if y else 2", "elif x:", "f(", ")", "x = '#'", "while x: y", "", "import a"]
    texts = [*made(2000, 4), *["\n".join(draw.choice(lines) for _ in range(draw.randint(1, 6))) for _ in range(4000)]]
    got = complexities(pa.array(texts))
    assert got == [cell_complexity(t) for t in texts]
    assert [g > 0 for g in got] == [by_tree(t) for t in texts]
    assert sum(g > 0 for g in got) > 200


TOKENS = [
    "a", "b", "f", "1", "0", "01", "1.5", ".", "a.b", "True", "None", "(", ")", "[", "]", "(", ")", ",", "=", "+=", "+", "-", "*", "**", "==", "<", "and", "or",
    "in", "is", "not", "if", "for", "while", "import", "from", "as", "def", "try", "except", "else", "return", "pass", ":", "\n", "\n    ", "\n  ", "# c", "~", "!=", "f(a)",
    "a[0]", "a, b", "x = 1", "f(a=1)", "a=1", "if a:", "try:", "except A:", "finally:", "for i in b:", "def f(a, b=1):", "import a", "from a import b", "1.", "..", "match",
    "print", "lambda", "!", "<>", "//=", "@", "{", ";", "elif b:", "\n    pass", "\n    x = 1", "except:", "'a'", "\t", "a[1:2]", "async", "print a", "\n\n",
]
PARSED = [
    "", "\n\n", "# only", "x = f(a, b=1)\ny += x[0].z", "a = b = c, 1.5", "import a.b as c, d\nfrom e.f import g, h as i", "if a < b and c:\n    f(\n  a,\n)\nelif d:\n    pass",
    "try:\n    for i in range(3):\n        h(i,\n          2)\nexcept ValueError:\n    pass", "def f(x, y=2):\n    return x ** -2 + y", "  # c\nx = [1, 2]  # d (\n", "def f():\n  while a:\n    b = ()\n  return",
]
BROKEN = [
    "if a, b:\n    c", "f(a=1, b)", "f() = 1", "a + b = 1", "a, b += 1", "x = 1 y", "def f(a=1, b):\n    pass", "if a:\nb", "if a:\n    b\n  c", " x", "try:\n    a\nb", "elif a:\n    b", "a[]", "(a]",
    "1.2.3", "1.a", "012", "a = 1 = b", "None = 1", "f(a.b=1)", "import a.b.", "from a import b.c", "import a as b.c", "from a.b as c import d", "[a=1]", "a b", "f(", ")", "x = ", "for a.b c:\n    d",
    "a <> b", "a = = b", "f(,)", "except:\n    a", "try:\n    a\nfinally:\n    b\nexcept:\n    c", "while a:", "a ++", "import", "return return", "f(a)(b) = c", "x: = 1", "f(a=b=c)", "f(a += 1)", "match a:\n    b",
]


def test_what_surely_parses_does():
    draw = random.Random(5)
    texts = [*(" ".join(draw.choice(TOKENS) for _ in range(draw.randint(1, 9))) for _ in range(20_000)), *("".join(draw.choice(TOKENS) for _ in range(draw.randint(1, 8))) for _ in range(20_000))]
    cells = S.Cells(pa.array([*PARSED, *BROKEN, *texts, "a", "a" * 900]))
    sure = surely_parse(cells, ~cells.odd())
    assert sure[: len(PARSED)].all()
    assert not any(by_tree(t) for t in BROKEN) and not sure[len(PARSED) : len(PARSED) + len(BROKEN)].any()
    taken = [t for t, s in zip(texts, sure[len(PARSED) + len(BROKEN) :]) if s]
    assert len(taken) > 2000 and all(map(by_tree, taken)) and sure[-2:].all()
    # Depths at which the parser gives up are left to it.
    deep = S.Cells(pa.array(["(" * 90 + "a" + ")" * 90, "a" + "**a" * 300, "- " * 400 + "a"]))
    assert not surely_parse(deep, ~deep.odd()).any()
