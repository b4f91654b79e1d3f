"""CyC: cyclomatic complexity of the module level of a cell.

The one metric that needs a parser.  Arrow batches go to the Python workers;
each distinct source of a batch is looked at once.  The words that make branches
are found in all short, plain sources of a batch at once, and those of simple
statements are known to parse without the parser.
"""

from __future__ import annotations

import ast
import gc
import re
import sys
import warnings

import _symtable
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from nbgauge.functions.grammar import surely_parse
from nbgauge.functions.scan import BLANK, ENDER, Cells, batches_of, code_of

# The functions travel with the query; workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Nodes whose inside does not count: the body of a function or class is not
# module level, and an assertion counts as one branch whatever it tests.
_CLOSED = {ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Assert}
_LEAVES = {ast.Name, ast.Constant, ast.Load, ast.Store, ast.Del, ast.Pass, ast.Import, ast.ImportFrom, ast.alias}


def _loop(node) -> int:
    return 1 + bool(node.orelse)


def _match(node) -> int:
    catch_all = any(isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None for c in node.cases)
    return len(node.cases) - catch_all


_BRANCHES = {
    ast.If: lambda node: 1,
    ast.IfExp: lambda node: 1,
    ast.Assert: lambda node: 1,
    ast.For: _loop,
    ast.AsyncFor: _loop,
    ast.While: _loop,
    ast.Try: lambda node: len(node.handlers) + bool(node.orelse),
    ast.BoolOp: lambda node: len(node.values) - 1,
    ast.comprehension: lambda node: 1 + len(node.ifs),
    ast.Match: _match,
}

# Fields that hold names, numbers and marks, and so no branch.
_PLAIN = {"ctx", "op", "ops", "id", "attr", "kind", "conversion", "type_comment", "type_ignores"}
_CHILDREN: dict[type, tuple[str, ...]] = {}

# Characters of a source whose syntax the symbol table may confirm: too few to nest so deep that only one of both gives up.
_SHORT = 1_000

# A source without any of these words has no branch.
_MAY_BRANCH = re.compile(r"\b(?:if|for|while|except|assert|and|or|match)\b")

# What words alone do not tell: text and unusual characters, closed bodies, an ``else`` (of a loop or not), patterns, ``except*``,
# numbers that run into a word.  Without any of it each word below is one branch.
_NEEDS_TREE = re.compile(
    r"""['"\\\r]|[^\x00-\x7f]|\b(?:def|class|assert|else|match|case)\b|\bexcept[ \t\f]*\*|\b[0-9][0-9_]*[a-zA-Z]"""
)
_COMMENT = re.compile("#.*")
_BRANCH_WORD = re.compile(r"\b(?:if|elif|for|while|except|and|or)\b")


def _children(kind: type) -> tuple[str, ...]:
    """Fields of a node that may lead to a branch."""
    open_ = issubclass(kind, ast.AST) and kind not in _CLOSED and kind not in _LEAVES
    return tuple(f for f in kind._fields if f not in _PLAIN) if open_ else ()


def _sound(source: str) -> bool:
    """Whether the symbol table takes a source, which is parsed for it without a tree of objects; it refuses more than the parser does."""
    try:
        _symtable.symtable(source, "<cell>", "exec")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def cell_complexity(source: str) -> float:
    """Complexity of one source; 0 if it does not parse."""
    source = source.replace("%matplotlib inline", "")
    branches = _MAY_BRANCH.search(source)
    if len(source) <= _SHORT and not (branches and _NEEDS_TREE.search(source)) and _sound(source):
        return 1.0 + (len(_BRANCH_WORD.findall(_COMMENT.sub("", source))) if branches else 0)
    return _tree_complexity(source, bool(branches))


def _tree_complexity(source: str, branches: bool) -> float:
    try:
        pending: list = [ast.parse(source)]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return 0.0
    if not branches:
        return 1.0
    total = 1
    while pending:
        node = pending.pop()
        kind = type(node)
        if kind in _BRANCHES:
            total += _BRANCHES[kind](node)
        fields = _CHILDREN.get(kind)
        if fields is None:
            fields = _CHILDREN[kind] = _children(kind)
        for field in fields:
            value = getattr(node, field, None)
            if isinstance(value, list):
                pending.extend(value)
            elif value is not None:
                pending.append(value)
    return float(total)


_MAY_CODES, _BRANCH_CODES, _TREE_CODES = (
    np.array([code_of(w) for w in words.split()], np.uint64)
    for words in ("if for while except assert and or match", "if elif for while except and or", "def class assert else match case")
)


def branch_words(cells: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per plain cell what the patterns above tell: whether it may branch, whether that needs a tree, and its branch words outside comments."""
    first, end, letter = cells.words()
    codes = np.where(letter == first, cells.codes(first, end), np.uint64(0))
    may = cells.count(first[np.isin(codes, _MAY_CODES)]) > 0
    needs = cells.count(first[np.isin(codes, _TREE_CODES) | ((letter > first) & (letter < end))]) > 0
    for character in "'\"\\":
        needs |= cells.count(cells.of(character)) > 0
    handlers = end[codes == np.uint64(code_of("except"))]
    if len(handlers):
        marks = np.flatnonzero(((cells.kind & BLANK) == 0) | ((cells.kind & ENDER) != 0))
        following = marks[np.searchsorted(marks, handlers)]
        needs[cells.cell[following[cells.bytes[following] == ord("*")]]] = True
    words = first[np.isin(codes, _BRANCH_CODES)]
    comments = cells.of("#")
    if len(comments) and len(words):
        at = np.searchsorted(comments, words) - 1
        enders = np.flatnonzero(cells.kind & ENDER)
        # A word is in a comment if no line ends between it and the sign before it.
        words = words[(at < 0) | (np.searchsorted(enders, comments[at]) != np.searchsorted(enders, words))]
    return may, needs, cells.count(words)


def complexities(sources: pa.Array) -> list[float]:
    """Complexity of each source of a batch without NULLs."""
    # Sources too long for the symbol table, or with a line that is cut, are told one by one.
    short = pc.and_(pc.less_equal(pc.binary_length(sources), _SHORT), pc.invert(pc.match_substring(sources, "%matplotlib")))
    shown = pc.if_else(short, sources, pa.scalar("", sources.type))
    out: list[float] = []
    for a, b in batches_of(shown):
        cells = Cells(shown.slice(a, b - a))
        may, needs, words = branch_words(cells)
        told = short.slice(a, b - a).to_numpy(zero_copy_only=False) & ~cells.odd() & ~(may & needs)
        found = np.where(may, words, 0) + 1.0
        # The parser is asked for what a simpler check does not know.
        left = np.flatnonzero(~surely_parse(cells, told))
        for at, source in zip(left.tolist(), sources.take(pa.array(left + a)).to_pylist()):
            if not told[at]:
                found[at] = cell_complexity(source)
            elif not _sound(source):
                found[at] = _tree_complexity(source, bool(may[at]))
        out += found.tolist()
    return out


@F.arrow_udf(DoubleType())
def _complexity_of_batch(sources: pa.Array) -> pa.Array:
    encoded = sources.dictionary_encode()
    collects = gc.isenabled()
    # Trees are let go as soon as they are counted; a search for cycles among their nodes would find none.
    gc.disable()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            distinct = pa.array(complexities(encoded.dictionary), pa.float64())
    finally:
        if collects:
            gc.enable()
    return distinct.take(encoded.indices)


def cyclomatic_complexity(source: Column) -> Column:
    """CyC of a cell source."""
    return _complexity_of_batch(F.coalesce(source, F.lit("")))
