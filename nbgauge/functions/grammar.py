"""Cells that surely parse, told for many cells at once.

A small part of Python's grammar is checked without a parser: statements of names, whole and
decimal numbers, operators, calls, subscripts, lists, imports, and blocks.  Which token may
follow which is a table; brackets, assignments, arguments and indents are checked on top.  Whatever
else a cell holds (text, dictionaries, slices, ``not``, ``else`` ...), it is left to the parser,
as is every cell that does not parse.
"""

from __future__ import annotations

import keyword
import sys

import numpy as np
from pyspark import cloudpickle

from nbgauge.functions.scan import ENDER, MASKS, SYMBOL, Cells, code_of

# The functions travel with the query; workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Brackets in brackets, powers of powers; the parser takes more of both.
DEEPEST, MOST_POWERS = 6, 20

_TYPES = (
    "none NL NAME NUM CONST CALL GROUP CLOSE SUB LIST END COMMA DOT COLON ASSIGN AUG BIN POWER SIGN LOGIC IN OTHER IMPORT FROM AS IF ELIF WHILE FOR TRY "
    "EXCEPT FINALLY PASS RETURN DEF INAME ICOMMA IDOT MNAME MDOT MIMPORT DNAME DOPEN DPARAM DASSIGN DVALUE DCOMMA DCLOSE"
)
(
    NONE, NL, NAME, NUM, CONST, CALL, GROUP, CLOSE, SUB, LIST, END, COMMA, DOT, COLON, ASSIGN, AUG, BIN, POWER, SIGN, LOGIC, IN, OTHER, IMPORT, FROM, AS, IF, ELIF,
    WHILE, FOR, TRY, EXCEPT, FINALLY, PASS, RETURN, DEF, INAME, ICOMMA, IDOT, MNAME, MDOT, MIMPORT, DNAME, DOPEN, DPARAM, DASSIGN, DVALUE, DCOMMA, DCLOSE,
) = range(len(_TYPES.split()))

_OPENERS = (IF, ELIF, WHILE, FOR, TRY, EXCEPT, FINALLY, DEF)


def _following() -> np.ndarray:
    table = np.zeros((DCLOSE + 1, DCLOSE + 1), bool)

    def after(before, *types) -> None:
        for b in before if isinstance(before, tuple) else (before,):
            table[b, list(types)] = True

    ends, starts = (NAME, NUM, CONST, CLOSE, END), (NAME, NUM, CONST, GROUP, LIST)
    after(ends, BIN, POWER, SIGN, LOGIC, IN, COMMA, CLOSE, END, NL, ASSIGN, AUG, COLON)
    after((NAME, CLOSE, END), CALL, SUB, DOT)
    after((BIN, POWER, LOGIC, IN, ASSIGN, AUG, SUB, IF, ELIF, WHILE), *starts, SIGN)
    after(SIGN, *starts)
    after((GROUP, CALL), *starts, SIGN, CLOSE)
    after(LIST, *starts, SIGN, END)
    after(COMMA, *starts, SIGN, CLOSE, END, NL)
    after(DOT, NAME)
    after((COLON, PASS), NL)
    after(NL, NL, *starts, SIGN, PASS, RETURN, IMPORT, FROM, *_OPENERS)
    after(RETURN, *starts, SIGN, NL)
    after((TRY, FINALLY), COLON)
    after(EXCEPT, NAME, GROUP, COLON)
    after(FOR, NAME)
    after((IMPORT, MIMPORT, ICOMMA), INAME)
    after(INAME, IDOT, ICOMMA, AS, NL)
    after((IDOT, AS), INAME)
    after((FROM, MDOT), MNAME)
    after(MNAME, MDOT, MIMPORT)
    after(DEF, DNAME)
    after(DNAME, DOPEN)
    after((DOPEN, DCOMMA), DPARAM, DCLOSE)
    after(DPARAM, DASSIGN, DCOMMA, DCLOSE)
    after(DASSIGN, DVALUE)
    after(DVALUE, DCOMMA, DCLOSE)
    after(DCLOSE, COLON)
    return table


_SETS: dict[tuple, np.ndarray] = {}


def _among(types: tuple) -> np.ndarray:
    """Whether a type is one of these."""
    if types not in _SETS:
        _SETS[types] = np.zeros(DCLOSE + 1, bool)
        _SETS[types][list(types)] = True
    return _SETS[types]


#: Digits of the places in a table of words.
SLOTS = 12


def _slots(codes: np.ndarray, factor: int) -> np.ndarray:
    return (codes * np.uint64(factor)) >> np.uint64(64 - SLOTS)


def _placed(kinds: dict[str, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """Words by a hash that gives each a place of its own."""
    codes = np.array([code_of(w) for w in kinds], np.uint64)
    factor = 0x9E3779B97F4A7C15
    while len(np.unique(_slots(codes, factor))) < len(codes):
        factor = (factor * 0xD1342543DE82EF95 + 2) & 0xFFFFFFFFFFFFFFFF | 1
    at = _slots(codes, factor)
    known, types = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.uint8)
    known[at], types[at] = codes, list(kinds.values())
    return factor, known, types


def _single() -> np.ndarray:
    """Types of single characters; those that are part of no token that is known make a cell unknown."""
    table = np.zeros(256, np.uint8)
    table[[9, *range(33, 127)]] = OTHER
    for character in "#_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+-*/%=&|^<>~!":
        table[ord(character)] = NONE
    for character, kind in {"(": GROUP, ")": CLOSE, "[": LIST, "]": END, ",": COMMA, ".": DOT, ":": COLON}.items():
        table[ord(character)] = kind
    return table


FOLLOWS, SINGLE = _following(), _single()
WORDS = _placed(
    {w: OTHER for w in (*keyword.kwlist, "match", "case")}
    | {"True": CONST, "False": CONST, "None": CONST, "and": LOGIC, "or": LOGIC, "in": IN, "is": BIN, "import": IMPORT, "from": FROM, "as": AS, "if": IF, "elif": ELIF}
    | {"while": WHILE, "for": FOR, "try": TRY, "except": EXCEPT, "finally": FINALLY, "pass": PASS, "return": RETURN, "def": DEF}
)
SIGNS = _placed(
    {s: BIN for s in "* / // % == != < > <= >= & | ^ << >>".split()} | {s: AUG for s in "+= -= *= /= %= //= **= &= |= ^= >>= <<=".split()}
    | {"+": SIGN, "-": SIGN, "**": POWER, "=": ASSIGN}
)


def _looked_up(table: tuple[int, np.ndarray, np.ndarray], codes: np.ndarray, other: int) -> np.ndarray:
    factor, known, types = table
    at = _slots(codes, factor)
    return np.where((known[at] == codes) & (codes != 0), types[at], np.uint8(other))


def _tokens(cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """Places and types of all tokens outside comments; line ends are tokens."""
    first, end, letter = cells.words()
    kinds = _looked_up(WORDS, cells.codes(first, end), NAME)
    digits = letter > first
    whole = (letter == end) & ((cells.bytes[first] != ord("0")) | (end - first == 1))
    kinds[digits] = np.where(whole[digits], NUM, OTHER)
    mark = SINGLE[cells.bytes]
    mark[first] = kinds
    sign = (cells.kind & SYMBOL) != 0
    edges = np.flatnonzero(sign[1:] != sign[:-1]) + 1
    begin, length = edges[::2], edges[1::2] - edges[::2]
    mark[begin] = np.where(length <= 3, _looked_up(SIGNS, cells.eight[begin] & MASKS[np.minimum(length, 3)], OTHER), OTHER)
    enders = np.flatnonzero(cells.kind & ENDER)
    # Only those of the texts: the bytes before and after them are of no kind.
    mark[enders] = NL
    # Decimal numbers are one token.
    points = np.flatnonzero((end[:-1] + 1 == first[1:]) & (cells.bytes[end[:-1]] == ord(".")) & digits[:-1] & digits[1:] & (letter[:-1] == end[:-1]) & (letter[1:] == end[1:])) if len(first) else first
    points = points[(cells.bytes[first[points] - 1] != ord(".")) & (cells.bytes[end[points + 1]] != ord("."))] if len(points) else points
    mark[end[points]] = NONE
    mark[first[points + 1] if len(points) else points] = NONE
    comments = cells.of("#")
    if len(comments):
        line = np.searchsorted(enders, comments)
        comments, line = comments[np.diff(line, prepend=-1) != 0], line[np.diff(line, prepend=-1) != 0]
        length = enders[line] - comments
        mark[np.repeat(comments - (np.cumsum(length) - length), length) + np.arange(length.sum())] = NONE
    places = np.flatnonzero(mark)
    return places, mark[places]


def _blocks_fit(lines: list[tuple[int, int]]) -> bool:
    """Whether indents and the parts of compound statements follow each other as they must; lines are indent and first token."""
    indents, before = [0], [NONE]
    opened = False
    for indent, kind in lines:
        if opened:
            if indent <= indents[-1]:
                return False
            indents.append(indent)
            before.append(NONE)
        while indent < indents[-1]:
            if before[-1] == TRY:
                return False
            indents.pop()
            before.pop()
        if indent != indents[-1]:
            return False
        last = before[-1]
        if kind == ELIF and last not in (IF, ELIF) or kind in (EXCEPT, FINALLY) and last not in (TRY, EXCEPT) or last == TRY and kind not in (EXCEPT, FINALLY):
            return False
        before[-1] = kind
        opened = kind in _OPENERS
    return not opened and TRY not in before


def surely_parse(cells: Cells, asked: np.ndarray) -> np.ndarray:
    """Which of the asked cells are known to parse."""
    bad = ~asked
    places, kinds = _tokens(cells)
    cell = cells.cell[places]
    bad |= np.bincount(cell[kinds == OTHER], minlength=cells.n) > 0
    bad |= np.bincount(cell[kinds == POWER], minlength=cells.n) > MOST_POWERS

    def good(*arrays):
        kept = ~bad[arrays[0]]
        return [a[kept] for a in arrays]

    def wrong(where: np.ndarray) -> None:
        bad[cell[where]] = True

    cell, places, kinds = good(cell, places, kinds)
    if not len(places):
        return ~bad
    opens, closes = (kinds == GROUP) | (kinds == LIST), (kinds == CLOSE) | (kinds == END)
    change = opens.astype(np.int64) - closes
    depth = np.cumsum(change)
    begin = np.append(True, cell[1:] != cell[:-1])
    depth -= np.repeat((depth - change)[begin], np.diff(np.append(np.flatnonzero(begin), len(cell))))
    last = np.append(cell[1:] != cell[:-1], True)
    wrong((depth < 0) | (depth > DEEPEST) | last & (depth != 0))
    # Line ends inside brackets and behind empty lines are none.
    ended = kinds == NL
    kept = ~bad[cell] & ~(ended & (depth != 0))
    cell, places, kinds, depth = (a[kept] for a in (cell, places, kinds, depth))
    kept = ~((kinds == NL) & np.append(True, (kinds[:-1] == NL) | (cell[1:] != cell[:-1])))
    cell, places, kinds, depth = (a[kept] for a in (cell, places, kinds, depth))
    if not len(places):
        return ~bad
    size = len(kinds)
    place = np.arange(size)
    before = np.append(NL, kinds[:-1])
    calls = _among((NAME, CLOSE, END))[before]
    kinds[(kinds == GROUP) & calls] = CALL
    kinds[(kinds == LIST) & calls] = SUB
    before = np.append(NL, kinds[:-1])
    begins = before == NL
    line = np.cumsum(begins) - 1
    heads = np.flatnonzero(begins)
    head = kinds[heads]
    own_head = head[line]
    twice = np.append([NL, NL], kinds[:-2])[:size]
    flat = depth == 0

    # Imports and the heads of functions have tokens of their own.
    for kind, changes in ((IMPORT, {NAME: INAME, COMMA: ICOMMA, DOT: IDOT}), (FROM, {NAME: MNAME, DOT: MDOT, IMPORT: MIMPORT})):
        inside = own_head == kind
        for old, new in changes.items():
            kinds[inside & (kinds == old) & ~begins] = new
    names = np.flatnonzero(kinds == MIMPORT)
    if len(names):
        at = np.searchsorted(names, place) - 1
        behind = (at >= 0) & (own_head == FROM) & (line[names[at]] == line) & (place > names[at])
        for old, new in ((MNAME, INAME), (COMMA, ICOMMA)):
            kinds[behind & (kinds == old)] = new
    # A dotted name stands in 'import a.b' only; 'as' takes one plain name, once.
    dotted = np.flatnonzero(kinds == IDOT)
    wrong(dotted[own_head[dotted] == FROM])
    named = np.flatnonzero(kinds == AS)
    behind = named[named + 2 < size] + 2
    wrong(behind[_among((IDOT, AS))[kinds[behind]]])
    heading = own_head == DEF
    if heading.any():
        first = heads[line]
        kinds[heading & (place == first + 1) & (kinds == NAME)] = DNAME
        kinds[heading & (place == first + 2) & (kinds == CALL)] = DOPEN
        inside = heading & (place > first + 2)
        value = inside & (before == ASSIGN) & _among((NAME, NUM, CONST))[kinds]
        kinds[inside & (kinds == NAME) & ~value] = DPARAM
        kinds[value] = DVALUE
        for old, new in ((COMMA, DCOMMA), (ASSIGN, DASSIGN), (CLOSE, DCLOSE)):
            kinds[inside & (kinds == old)] = new
        # A parameter without a default may not follow one that has it.
        parameters = np.flatnonzero(kinds == DPARAM)
        has = kinds[np.minimum(parameters + 1, size - 1)] == DASSIGN
        wrong(parameters[1:][has[:-1] & ~has[1:] & (line[parameters[1:]] == line[parameters[:-1]])])

    before = np.append(NL, kinds[:-1])
    wrong(~FOLLOWS[before, kinds])
    # Heads of blocks end with a colon, and nothing else has one.
    colons = kinds == COLON
    opener = _among(_OPENERS)[head]
    wrong(colons & (~flat | ~opener[line]))
    wrong(heads[opener & (np.bincount(line[colons], minlength=len(heads)) != 1)])
    loops = heads[head == FOR]
    wrong(loops[kinds[np.minimum(loops + 2, size - 1)] != IN])
    wrong((kinds == COMMA) & flat & _among((IF, ELIF, WHILE, EXCEPT))[own_head])
    # What is assigned to: names, attributes, subscripts.
    for kind, allowed in ((ASSIGN, (NAME, DOT, COMMA, ASSIGN, SUB, END)), (AUG, (NAME, DOT, SUB, END))):
        equal = np.flatnonzero((kinds == kind) & flat)
        if len(equal):
            latest = np.full(len(heads), -1)
            latest[line[equal]] = equal
            # An opening bracket counts as outside of itself here, as its end does.
            outer = flat | (depth == 1) & _among((SUB, CALL, GROUP, LIST))[kinds]
            wrong((place < latest[line]) & outer & ~_among(allowed)[kinds])
            wrong(equal[~_among((NAME, END))[before[equal]]])
            if kind == AUG:
                wrong(equal[latest[line[equal]] != equal])
                wrong((kinds == ASSIGN) & flat & (latest[line] >= 0))
    wrong((kinds == AUG) & ~flat)
    # Brackets of a level open and close in turn, by the same sign; named arguments stand in calls, behind the others.
    named = np.flatnonzero((kinds == ASSIGN) & ~flat)
    wrong(named[(before[named] != NAME) | ~_among((CALL, GROUP, COMMA))[twice[named]]])
    opens = _among((CALL, GROUP, SUB, LIST, DOPEN))[kinds]
    level = depth + _among((CLOSE, END, DCLOSE))[kinds]
    for d in range(1, int(depth.max(initial=0)) + 1):
        pairs = np.flatnonzero((level == d) & (opens | _among((CLOSE, END, DCLOSE))[kinds]))
        o, c = pairs[::2], pairs[1::2]
        wrong(o[_among((SUB, LIST))[kinds[o]] != (kinds[c] == END)])
        own = named[depth[named] == d]
        if len(own):
            wrong(own[kinds[o[np.searchsorted(o, own) - 1]] != CALL])
            starts = np.flatnonzero((depth == d) & ((before == CALL) | (before == COMMA)) & ~_among((CLOSE, END))[kinds] & (np.append(0, depth[:-1]) == d))
            # A bracket that starts an argument is one level further in.
            inner = np.flatnonzero(opens & (depth == d + 1) & ((before == CALL) | (before == COMMA)) & (np.append(0, depth[:-1]) == d))
            starts = np.sort(np.concatenate([starts, inner]))
            owner = np.searchsorted(o, starts) - 1
            has = kinds[np.minimum(starts + 1, size - 1)] == ASSIGN
            wrong(starts[1:][has[:-1] & ~has[1:] & (owner[1:] == owner[:-1])])
    # Indents.
    starts = np.flatnonzero(cells.kind & ENDER)
    starts = np.concatenate([[cells.EDGE], starts[:-1] + 1])
    indent = places[heads] - starts[np.searchsorted(starts, places[heads], side="right") - 1]
    of_line = cell[heads]
    nested = (np.bincount(of_line, weights=(indent > 0) | opener | _among((EXCEPT, FINALLY))[head], minlength=cells.n) > 0) & ~bad
    some = nested[of_line]
    of_line, indent, head = of_line[some], indent[some], head[some]
    cuts = np.flatnonzero(np.append(True, of_line[1:] != of_line[:-1])) if len(of_line) else np.zeros(0, np.int64)
    pairs = list(zip(indent.tolist(), head.tolist()))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of_line)]):
        if not _blocks_fit(pairs[a:b]):
            bad[of_line[a]] = True
    return ~bad
