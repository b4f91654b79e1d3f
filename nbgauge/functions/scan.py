"""Metrics of many code cells at once, from their bytes.

The functions of ``code`` take a pass over a cell per metric.  Here the cells of an Arrow batch
lie one behind the other as bytes, and each step is taken for all of them: signs by place, words
as runs of letters, lines and operands told apart by hashes that are compared byte by byte where
they agree.  Only plain cells are taken: ASCII without other control characters than tab and line
end, of bounded length, without a delimiter that spans lines.  Of any other cell nothing is said,
and the functions of ``code`` give its metrics; both agree on every plain cell.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

# The functions travel with the query; workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of a cell that is taken, and of the cells that are worked on together.
LONG, TOGETHER = 16_384, 1 << 21

WHOLE = (
    "LOC", "UDF", "I", "EH", "S", "P", "OPRATOR", "OPRND", "UOPRND", "UOPRATOR", "ID", "ALID", "MLID", "hash_lines", "CW",
)
FRACTIONS = ("ALLC", "KLCID", "NBD")
_KINDS = pa.struct([*[pa.field(m, pa.int64()) for m in WHOLE], *[pa.field(m, pa.float64()) for m in FRACTIONS]])
SCANNED = StructType([*[StructField(m, LongType()) for m in WHOLE], *[StructField(m, DoubleType()) for m in FRACTIONS]])

KEYWORDS = (
    "True", "False", "None", "and", "as", "assert", "break", "class", "continue", "def", "del", "elif", "else",
    "except", "finally", "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or",
    "pass", "raise", "return", "try", "while", "with", "yield",
)
WORD_OPERATORS = (" and ", " or ", " not ", " is ", " is not ", " in ", " not in ")
SYMBOLS = b"+-*/%=&|^<>~!"
DELIMITERS = b"-()+*/=&|^~<>%"

# Classes of bytes.
DIGIT, LETTER, BLANK, SYMBOL, DELIMITER, ENDER, ODD = (1 << k for k in range(7))


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)

    def mark(chars: bytes, kind: int) -> None:
        table[np.frombuffer(chars, np.uint8)] |= kind

    mark(b"0123456789", DIGIT)
    mark(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_", LETTER)
    mark(b" \t\n\0", BLANK)
    mark(SYMBOLS, SYMBOL)
    mark(DELIMITERS + b"\0", DELIMITER)
    mark(b"\n\0", ENDER)
    plain = np.zeros(256, bool)
    plain[32:127] = True
    plain[[9, 10]] = True
    table[~plain] |= ODD
    return table


CLASSES = _classes()


def code_of(piece: str | bytes) -> int:
    """Up to eight characters as a number."""
    return int.from_bytes(piece.encode() if isinstance(piece, str) else piece, "little")


def _mask(length: int) -> int:
    return (1 << 8 * length) - 1


MASKS = np.array([_mask(k) for k in range(9)], np.uint64)
KEYWORD_CODES = np.sort(np.array([code_of(w) for w in KEYWORDS], np.uint64))

# Odd factor of the hashes of texts, and its inverse among the 64-bit numbers.
FACTOR = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {"up": np.zeros(0, np.uint64), "down": np.zeros(0, np.uint64)}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < size:
        for name, factor in (("up", FACTOR), ("down", pow(FACTOR, -1, 1 << 64))):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:size], _powers["down"][:size]


class Cells:
    """Texts one behind the other, a zero byte after each; ``first`` and ``end`` are the places of a text."""

    #: Zero bytes before the first text and after the last.
    EDGE = 16

    def __init__(self, texts: pa.Array):
        self.n = len(texts)
        joined = pc.binary_join_element_wise(texts.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\0", pa.large_binary()))
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + self.n + 1]
        size = int(offsets[-1] - offsets[0])
        self.bytes = np.zeros(size + 2 * self.EDGE, np.uint8)
        if size:
            self.bytes[self.EDGE : self.EDGE + size] = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        places = offsets - offsets[0] + self.EDGE
        self.first, self.end = places[:-1], places[1:] - 1
        self.length = self.end - self.first
        self.kind = CLASSES[self.bytes]
        self.kind[: self.EDGE] = self.kind[self.EDGE + size :] = BLANK | DELIMITER
        self.cell = np.zeros(len(self.bytes), np.int32)
        self.cell[self.EDGE : self.EDGE + size] = np.repeat(np.arange(self.n, dtype=np.int32), self.length + 1)
        # The eight characters from each place on.
        self.eight = np.ndarray(len(self.bytes) - 8, "<u8", self.bytes.data, strides=(1,))
        self._hashed: np.ndarray | None = None

    def count(self, places: np.ndarray) -> np.ndarray:
        """Places per cell."""
        return np.bincount(self.cell[places], minlength=self.n)

    def added(self, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.cell[places], weights=weights, minlength=self.n).astype(np.int64)

    def of(self, character: str) -> np.ndarray:
        return np.flatnonzero(self.bytes == ord(character))

    def pieces(self, places: np.ndarray, piece: str) -> np.ndarray:
        """Those of the places at which a piece of up to eight characters begins."""
        return places[(self.eight[places] & MASKS[len(piece)]) == np.uint64(code_of(piece))]

    def odd(self) -> np.ndarray:
        """Cells with a byte that is not plain, besides the zero after them."""
        return self.count(np.flatnonzero(self.kind & ODD)) > 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First place, end and place of the first letter of each run of letters and digits; the letter lies at the end if there is none."""
        word = (self.kind & (DIGIT | LETTER)) != 0
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        first, end = edges[::2], edges[1::2]
        letter = first.copy()
        late = np.flatnonzero(self.kind[first] & DIGIT)
        if len(late):
            letters = np.append(np.flatnonzero(((self.kind[1:] & LETTER) != 0) & ((self.kind[:-1] & DIGIT) != 0)) + 1, len(self.bytes))
            letter[late] = np.minimum(letters[np.searchsorted(letters, first[late])], end[late])
        return first, end, letter

    def codes(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Words of up to eight characters as numbers, longer ones as 0."""
        length = end - first
        return np.where(length <= 8, self.eight[first] & MASKS[np.minimum(length, 8)], np.uint64(0))

    def hashes(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A number per text between two places; equal texts have equal numbers."""
        up, down = _power_tables(len(self.bytes))
        if self._hashed is None:
            self._hashed = np.zeros(len(self.bytes) + 1, np.uint64)
            np.cumsum(self.bytes * up, out=self._hashed[1:])
        return (self._hashed[end] - self._hashed[first]) * down[first]

    def repeats(self, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts that came before in the same cell, and cells in which that could not be told."""
        cell, length = self.cell[first], end - first
        hashed = self.hashes(first, end)
        key = (hashed ^ (length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) + cell.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        order = np.sort(key)
        again = order[1:][order[1:] == order[:-1]]
        nothing = np.zeros(0, np.int64)
        if not len(again):
            return nothing, nothing
        at = np.minimum(np.searchsorted(again, key), len(again) - 1)
        some = np.flatnonzero(again[at] == key)
        # Of these each is compared with the one before it that has the same hash, length and cell.
        some = some[np.lexsort((some, hashed[some], length[some], cell[some]))]
        a, b = some[:-1], some[1:]
        same = (cell[a] == cell[b]) & (length[a] == length[b]) & (hashed[a] == hashed[b])
        a, b = a[same], b[same]
        if not len(b):
            return nothing, nothing
        long = length[b]
        inside = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
        differs = self.bytes[np.repeat(first[a], long) + inside] != self.bytes[np.repeat(first[b], long) + inside]
        return b, np.unique(np.repeat(cell[b], long)[differs])


def _apart(places: np.ndarray, length: int) -> np.ndarray:
    """Places of a piece that are counted if no two may overlap; its ends are the same character, nothing else of it overlaps."""
    chained = np.diff(places) == length - 1
    if not chained.any():
        return places
    begin = np.flatnonzero(np.concatenate([[True], ~chained]))
    link = np.arange(len(places)) - np.repeat(begin, np.diff(np.append(begin, len(places))))
    return places[link % 2 == 0]


def _parameters(cells: Cells, words: tuple[np.ndarray, np.ndarray, np.ndarray], breaks: np.ndarray) -> np.ndarray:
    """Arguments of all calls of each cell; see ``code.parameters_of``."""
    _, end, letter = words
    opened = end[(cells.bytes[end] == ord("(")) & (letter < end)]
    closed, commas, round_ = cells.of(")"), cells.of(","), cells.of("(")
    at = np.searchsorted(closed, opened)
    there = np.flatnonzero(at < len(closed))
    there = there[cells.cell[opened[there]] == cells.cell[closed[at[there]]]]
    # A call runs to the first ')' behind it; calls inside it end there too and are not looked at.
    there = there[np.diff(at[there], prepend=-1) != 0]
    opened, close = opened[there], closed[at[there]]
    # Of a call over many lines only what stands behind the first '(' of the last line counts.
    line = np.searchsorted(breaks, close)
    last = np.where(line > 0, breaks[line - 1], -1) if len(breaks) else np.full(len(close), -1)
    many = last > opened
    again = np.searchsorted(round_, last)
    begin = np.append(round_, len(cells.bytes))[again]
    lost = many & (begin > close)
    begin = np.where(many, begin, opened)
    total = cells.added(opened, np.searchsorted(commas, close) - np.searchsorted(commas, np.minimum(begin, close)) + 1)
    total[cells.cell[opened[lost]]] = 0
    return total


def _operators(cells: Cells, blanks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of all operators, and operators that occur, per cell."""
    signs = np.flatnonzero(cells.kind & SYMBOL)
    sign, after, third = cells.bytes[signs], cells.bytes[signs + 1], cells.bytes[signs + 2]
    found = [signs[sign == s] for s in SYMBOLS if s != ord("!")]
    pairs = np.flatnonzero(cells.kind[signs + 1] & SYMBOL)
    if len(pairs):
        signs, sign, after, third = signs[pairs], sign[pairs], after[pairs], third[pairs]
        equal = after == ord("=")
        found += [signs[equal & (sign == s)] for s in b"+-*/%&|^!><"]
        twice = sign == after
        for s in b"*/<>=":
            double = twice & (sign == s)
            found.append(_apart(signs[double], 2))
            if s != ord("="):
                found.append(signs[double & (third == ord("="))])
    for word in WORD_OPERATORS:
        found.append(_apart(cells.pieces(blanks, word), len(word)))
    total, kinds = np.zeros(cells.n, np.int64), np.zeros(cells.n, np.int64)
    for places in found:
        if len(places):
            n = cells.count(places)
            total += n
            kinds += n > 0
    return total, kinds


def _comments(cells: Cells, line_first: np.ndarray, line_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a comment of one sign or more, and the words of the comments."""
    marks = cells.of("#")
    if not len(marks):
        return np.zeros(cells.n, np.int64), np.zeros(cells.n, np.int64)
    line = np.searchsorted(line_end, marks)
    keep = np.diff(line, prepend=-1) != 0
    marks, line = marks[keep], line[keep]
    keep = marks + 1 < line_end[line]
    marks, line = marks[keep], line[keep]
    blank = (cells.kind & BLANK) != 0
    begins = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    words = np.searchsorted(begins, line_end[line]) - np.searchsorted(begins, marks + 1) + ~blank[marks + 1]
    return cells.count(marks), cells.added(marks, words)


def scanned(cells: Cells) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Metrics of each cell, and whether they hold."""
    out: dict[str, np.ndarray] = {}
    taken = ~cells.odd()
    breaks, blanks, i_places = cells.of("\n"), cells.of(" "), cells.of("i")
    line_end = np.flatnonzero(cells.kind & ENDER)
    line_first = np.concatenate([[cells.EDGE], line_end[:-1] + 1]) if len(line_end) else line_end
    lines = cells.count(breaks) + 1
    out["LOC"] = lines
    out["ALLC"] = (cells.length - (lines - 1)) / lines
    out["NBD"] = cells.count(blanks) / lines
    # Lines with 'def ' that do not begin with a comment.
    line = np.unique(np.searchsorted(line_end, cells.pieces(cells.of("d"), "def ")))
    out["UDF"] = cells.count(line_first[line[cells.bytes[line_first[line]] != ord("#")]])
    out["I"] = cells.count(cells.pieces(i_places, "import "))
    out["EH"] = cells.count(cells.pieces(cells.of("t"), "try:"))
    out["S"] = cells.count(np.concatenate([cells.pieces(cells.of("w"), "while"), cells.pieces(cells.of("f"), "for"), cells.pieces(i_places, "if")]))
    words = cells.words()
    out["P"] = _parameters(cells, words, breaks)
    out["OPRATOR"], out["UOPRATOR"] = _operators(cells, blanks)

    # A '!' is part of a delimiter before '=' only.
    part = (cells.kind & DELIMITER) != 0
    negated = cells.of("!")
    part[negated[cells.bytes[negated + 1] == ord("=")]] = True
    edges = np.flatnonzero(part[1:] != part[:-1]) + 1
    first, end = edges[::2], edges[1::2]
    again, unclear = cells.repeats(first, end)
    taken[unclear] = False
    out["OPRND"] = cells.count(first)
    out["UOPRND"] = out["OPRND"] - cells.count(first[again])
    # Delimiters that span lines are left to the patterns.
    deep = breaks[(cells.eight[breaks + 1] & MASKS[4]) == np.uint64(code_of("    "))] + 5
    if len(deep):
        starts = cells.eight[deep]
        spanning = np.isin(starts & MASKS[2], np.array([code_of(s) for s in ("**", ">>", "+=", "==")], np.uint64)) | ((starts & MASKS[3]) == np.uint64(code_of("//=")))
        taken[cells.cell[deep[spanning]]] = False

    _, end, letter = words
    there = letter < end
    letter, end = letter[there], end[there]
    codes = cells.codes(letter, end)
    named = ~(KEYWORD_CODES[np.minimum(np.searchsorted(KEYWORD_CODES, codes), len(KEYWORD_CODES) - 1)] == codes)
    letter, size = letter[named], (end - letter)[named]
    out["ID"] = cells.count(letter)
    out["ALID"] = cells.added(letter, size) // np.maximum(out["ID"], 1)
    out["MLID"] = np.zeros(cells.n, np.int64)
    some = np.flatnonzero(out["ID"])
    if len(some):
        out["MLID"][some] = np.maximum.reduceat(size, (np.cumsum(out["ID"]) - out["ID"])[some])
    per_line = np.diff(np.searchsorted(letter, line_end), prepend=0)
    some = np.flatnonzero(per_line)
    again, unclear = cells.repeats(line_first[some], line_end[some])
    taken[unclear] = False
    some = np.delete(some, again)
    n = cells.count(line_first[some])
    out["KLCID"] = cells.added(line_first[some], per_line[some]) / np.maximum(n, 1)
    out["hash_lines"], out["CW"] = _comments(cells, line_first, line_end)
    return out, taken


def batches_of(texts: pa.Array) -> list[tuple[int, int]]:
    """Runs of texts that are worked on together."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    cuts = [0]
    while cuts[-1] < len(texts):
        before = upto[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(upto, before + TOGETHER, side="right"))))
    return list(zip(cuts, cuts[1:]))


def scan(texts: pa.Array) -> pa.StructArray:
    """Metrics of each text; NULL for one that is not taken."""
    fits = pc.less_equal(pc.binary_length(texts), LONG)
    fits = pc.fill_null(fits, False)
    shown = pc.if_else(fits, texts, pa.scalar("", texts.type))
    parts, held = [], []
    for a, b in batches_of(shown):
        found, taken = scanned(Cells(shown.slice(a, b - a)))
        parts.append(found)
        held.append(taken)
    taken = np.concatenate(held) & fits.to_numpy(zero_copy_only=False) if held else np.zeros(0, bool)
    arrays = [pa.array(np.concatenate([p[f.name] for p in parts]) if parts else [], f.type) for f in _KINDS]
    return pa.StructArray.from_arrays(arrays, fields=list(_KINDS), mask=pa.array(~taken))


@F.arrow_udf(SCANNED)
def _scan_of_batch(texts: pa.Array) -> pa.Array:
    encoded = texts.dictionary_encode()
    return scan(encoded.dictionary).take(encoded.indices)


def scan_of(source: Column) -> Column:
    """Metrics of plain cells from one pass, as a struct; NULL for any other."""
    return _scan_of_batch(source)
