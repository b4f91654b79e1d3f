"""Metrics of one code cell as Column expressions.

Every ``Column -> Column`` function takes the cell source and treats NULL as an
empty text, except the three size metrics that tell NULL from empty.  The
``*_of`` functions take an intermediate array, so that a plan can compute the
array once and derive several metrics from it.

Pattern flags: ``(?d)`` makes ``\\n`` the only line end, ``(?U)`` gives classes
their Unicode meaning.  Patterns are written so that a long cell stays linear:
a word is entered at its start only, and repeats are possessive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nbgauge.functions.text import SPACE, WORD, let, line_count, lines, matches, none, occurrences, or_empty, word_count

# Words that are not identifiers.
KEYWORDS = (
    "True", "False", "None", "and", "as", "assert", "break", "class", "continue", "def", "del", "elif", "else",
    "except", "finally", "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or",
    "pass", "raise", "return", "try", "while", "with", "yield",
)

# Operators; each is counted on its own, also inside a longer one.
OPERATORS = (
    "+", "-", "*", "/", "**", "%", "//", "=", "+=", "-=", "*=", "/=", "%=", "//=", "**=", "&=", "|=", "^=", ">>=",
    "<<=", "==", "!=", ">=", "<=", ">", "<", " and ", " or ", " not ", " is ", " is not ", " in ", " not in ",
    "&", "|", "^", "~", "<<", ">>",
)

SYMBOL_CHARACTERS = r"+\-*/%=&|\^<>!~"

IDENTIFIER = "[a-zA-Z_][a-zA-Z0-9_]*+"

# Delimiters of operands.  The last group needs its line break and four blanks.
OPERAND_DELIMITER = r"[\-()+*/=&|^~<>%]|!=|\n    (?:\*\*|>>|\+=|//=|==)"

CALL = rf"(?<![a-zA-Z0-9_])[0-9]*+{IDENTIFIER}\(([^)]*+)\)"

# Delimiters other than one sign of the first group, cheap to rule out.
BROKEN_DELIMITER = r"\n    (?:\*\*|>>|\+=|//=|==)"

IMPORT = (
    rf"(?dmU)^[\s\x1c-\x1f&&[^\n]]*+(?:from|import){SPACE}++({WORD}++(?:{SPACE}*+,{SPACE}*+{WORD}++)*+)"
)

COMMENT_BLOCK = (
    r"(?dmsU)^(?:'''.*?'''|" + r'""".*?""")' + rf"(?={SPACE}*\n|$)"
)


# -- size ---------------------------------------------------------------------


def lines_of_code(source: Column) -> Column:
    """LOC: lines; 0 for NULL, 1 for an empty text."""
    return F.when(source.isNull(), F.lit(0).cast("bigint")).otherwise(line_count(source))


def blank_cell(source: Column) -> Column:
    """BLC: 1 if the cell has no line at all, which only NULL has."""
    return source.isNull().cast("bigint")


def mean_line_length(source: Column) -> Column:
    """ALLC: mean characters per line, 0 for NULL."""
    count = line_count(source)
    return F.when(source.isNull(), F.lit(0.0)).otherwise((F.length(source) - (count - 1)) / count)


def nested_block_depth(source: Column) -> Column:
    """NBD: mean number of blanks per line."""
    text = or_empty(source)
    return occurrences(text, " ") / line_count(text)


# -- statements ---------------------------------------------------------------


def function_definitions(source: Column) -> Column:
    """UDF: lines with ``def `` whose first character is not ``#``."""
    text = or_empty(source)
    return F.when(F.contains(text, F.lit("def ")), matches(text, r"(?dm)^(?!#).*def ")).otherwise(none())


def import_statements(source: Column) -> Column:
    """I: occurrences of ``import ``."""
    return occurrences(or_empty(source), "import ")


def exception_handlers(source: Column) -> Column:
    """EH: occurrences of ``try:``."""
    return occurrences(or_empty(source), "try:")


def statements(source: Column) -> Column:
    """S: occurrences of ``while``, ``for`` and ``if``, also inside words."""
    text = or_empty(source)
    return occurrences(text, "while") + occurrences(text, "for") + occurrences(text, "if")


def parameters(source: Column) -> Column:
    """P: arguments of all calls; 0 if the last line of any call has no ``(``."""
    return let(call_arguments(source), parameters_of)


def call_arguments(source: Column) -> Column:
    """What each call has between its first ``(`` and ``)``.

    A call runs from its name to the first ``)``.  Text after the last ``)``
    cannot hold one and is cut, so no call is searched up to the end in vain.
    """
    text = or_empty(source)
    closed = F.left(text, F.length(text) - F.length(F.substring_index(text, ")", -1)))
    calls = F.regexp_extract_all(closed, F.lit(CALL), F.lit(1))
    return F.when(F.contains(text, F.lit(")")), calls).otherwise(F.array().cast("array<string>"))


def parameters_of(arguments: Column) -> Column:
    def of_one(inside: Column) -> Column:
        # In a call of many lines the arguments start at the first '(' of the last.
        last = F.substring_index(inside, "\n", -1)
        before = occurrences(F.substring_index(last, "(", 1), ",")
        many = F.when(F.contains(last, F.lit("(")), occurrences(last, ",") - before + 1)
        return F.when(F.contains(inside, F.lit("\n")), many).otherwise(occurrences(inside, ",") + 1)

    together = F.array_join(arguments, "")
    total = F.aggregate(F.transform(arguments, of_one), none(), lambda acc, n: acc + n)
    # Calls of one line each need not be told apart.
    flat = F.size(arguments) + occurrences(together, ",")
    return F.when(F.contains(together, F.lit("\n")), F.coalesce(total, none())).otherwise(flat)


# -- outputs ------------------------------------------------------------------


def display_outputs(output_type: Column) -> Column:
    """NVD."""
    return occurrences(or_empty(output_type), "display_data")


def result_outputs(output_type: Column) -> Column:
    """NEC."""
    return occurrences(or_empty(output_type), "execute_result")


# -- operators and operands ---------------------------------------------------


def operator_symbols(source: Column) -> Column:
    """A cell without what is no symbol, so that most passes of a count run over a short text."""
    return F.regexp_replace(or_empty(source), rf"[^{SYMBOL_CHARACTERS}]++", " ")


def operator_counts_of(source: Column, symbols: Column) -> Column:
    """Occurrences of operators: symbols first, then words; without kinds of which a cell has none."""
    text = or_empty(source)

    def counts(where: Column, ops: list[str]) -> Column:
        return F.array(*[occurrences(where, op) for op in ops])

    words = [op for op in OPERATORS if op.startswith(" ")]
    single = [op for op in OPERATORS if len(op) == 1]
    double = [op for op in OPERATORS if len(op) > 1 and op not in words]
    nothing = F.array().cast("array<bigint>")
    return F.concat(
        counts(symbols, single),
        F.when(F.regexp_like(symbols, F.lit(f"[{SYMBOL_CHARACTERS}]{{2}}")), counts(symbols, double)).otherwise(nothing),
        F.when(F.regexp_like(text, F.lit(" (?:and|or|not|i[sn]) ")), counts(text, words)).otherwise(nothing),
    )


def operator_counts(source: Column) -> Column:
    return let(operator_symbols(source), lambda symbols: operator_counts_of(source, symbols))


def operators_of(counts: Column) -> Column:
    return F.aggregate(counts, none(), lambda total, n: total + n)


def unique_operators_of(counts: Column) -> Column:
    return F.size(F.array_remove(counts, 0)).cast("bigint")


def operators(source: Column) -> Column:
    """OPRATOR: occurrences of all operators."""
    return operators_of(operator_counts(source))


def unique_operators(source: Column) -> Column:
    """UOPRATOR: operators that occur."""
    return unique_operators_of(operator_counts(source))


def operand_pieces(source: Column) -> Column:
    """Non-empty pieces between delimiters; every delimiter is made one ``=``, as cutting at a pattern compiles it anew for each cell."""
    text = or_empty(source)
    signs = F.regexp_replace(F.replace(text, F.lit("!="), F.lit("=")), r"[\-()+*/&|^~<>%]", "=")
    broken = F.contains(text, F.lit("\n    ")) & F.regexp_like(text, F.lit(BROKEN_DELIMITER))
    marked = F.when(broken, F.regexp_replace(text, OPERAND_DELIMITER, "=")).otherwise(signs)
    return F.array_remove(F.split(marked, "=", -1), "")


def operands(source: Column) -> Column:
    """OPRND: non-empty pieces between delimiters."""
    return F.size(operand_pieces(source)).cast("bigint")


def unique_operands(source: Column) -> Column:
    """UOPRND."""
    return F.size(F.array_distinct(operand_pieces(source))).cast("bigint")


# -- identifiers --------------------------------------------------------------


def identifier_tokens(source: Column) -> Column:
    """ASCII identifiers that are not keywords, with repeats."""
    words = F.regexp_extract_all(or_empty(source), F.lit(IDENTIFIER), F.lit(0))
    return F.filter(words, lambda word: ~word.isin(*KEYWORDS))


def identifiers_of(tokens: Column) -> Column:
    return F.size(tokens).cast("bigint")


def mean_identifier_length_of(tokens: Column) -> Column:
    letters = F.octet_length(F.array_join(tokens, "")).cast("bigint")
    return F.coalesce(
        F.call_function("div", letters, F.nullif(F.size(tokens), F.lit(0))), F.lit(0).cast("bigint")
    )


def max_identifier_length_of(tokens: Column) -> Column:
    longest = F.array_max(F.transform(tokens, lambda token: F.octet_length(token)))
    return F.coalesce(longest, F.lit(0)).cast("bigint")


def identifiers(source: Column) -> Column:
    """ID: identifiers, those in comments and strings included."""
    return identifiers_of(identifier_tokens(source))


def mean_identifier_length(source: Column) -> Column:
    """ALID: mean identifier length, rounded down."""
    return mean_identifier_length_of(identifier_tokens(source))


def max_identifier_length(source: Column) -> Column:
    """MLID."""
    return max_identifier_length_of(identifier_tokens(source))


def identifiers_per_line(source: Column) -> Column:
    """KLCID: identifiers per line, over the distinct lines that have any."""
    per_line = F.array_remove(
        F.transform(F.array_distinct(lines(or_empty(source))), lambda line: F.size(identifier_tokens(line))), 0
    )

    def mean(counts: Column) -> Column:
        return F.try_divide(F.aggregate(counts, F.lit(0), lambda acc, n: acc + n), F.size(counts))

    return F.coalesce(let(per_line, mean), F.lit(0.0))


# -- comments -----------------------------------------------------------------


def block_lines(source: Column) -> Column:
    """Lines of triple-quoted blocks at a line start."""
    text = or_empty(source)
    quoted = F.contains(text, F.lit("'''")) | F.contains(text, F.lit('"""'))
    blocks = F.regexp_extract_all(text, F.lit(COMMENT_BLOCK), F.lit(0))
    # Lines of all blocks: one per block plus the line breaks inside.
    return F.when(quoted, F.size(blocks) + occurrences(F.array_join(blocks, ""), "\n")).otherwise(none())


def comment_lines(source: Column) -> Column:
    """LOCom: lines of triple-quoted blocks at a line start, plus ``#`` comments."""
    text = or_empty(source)
    return block_lines(source) + F.when(F.contains(text, F.lit("#")), matches(text, "(?d)#.+")).otherwise(none())


def comment_words(source: Column) -> Column:
    """CW: words after the first ``#`` of a line."""
    text = or_empty(source)
    comments = F.regexp_extract_all(text, F.lit("(?d)#(.+)"), F.lit(1))
    return F.when(F.contains(text, F.lit("#")), word_count(F.array_join(comments, "\n"))).otherwise(none())


# -- imports ------------------------------------------------------------------


def import_groups(source: Column) -> Column:
    """Text after each ``import`` or ``from``: a name, or names with commas."""
    text = or_empty(source)
    some = F.contains(text, F.lit("import")) | F.contains(text, F.lit("from"))
    return F.when(some, F.regexp_extract_all(text, F.lit(IMPORT), F.lit(1))).otherwise(F.array().cast("array<string>"))


def imported_names_of(groups: Column, strict: bool = True) -> Column:
    if not strict:
        pieces = F.transform(groups, lambda item: F.split(item, rf"(?U){SPACE}*,{SPACE}*", -1))
        return F.flatten(pieces)

    names = F.array().cast("array<string>")
    start = F.struct(F.lit(False).alias("skip"), names.alias("kept"), names.alias("split"))

    def step(state: Column, item: Column) -> Column:
        splits = ~state["skip"] & F.contains(item, F.lit(","))
        return F.struct(
            splits.alias("skip"),
            F.when(splits, state["kept"]).otherwise(F.array_append(state["kept"], item)).alias("kept"),
            F.when(splits, F.concat(state["split"], F.split(F.replace(item, F.lit(" "), F.lit("")), ",", -1)))
            .otherwise(state["split"])
            .alias("split"),
        )

    scanned = F.aggregate(groups, start, step, lambda state: F.concat(state["kept"], state["split"]))
    # Without a comma nothing is split; the common case stays out of the fold.
    return F.when(F.contains(F.array_join(groups, " "), F.lit(",")), scanned).otherwise(groups)


def imported_names(source: Column, strict: bool = True) -> Column:
    """API: top-level names of import statements.

    ``import a.b`` gives ``a``; only the names before the first ``as`` of a
    comma list are seen.  By default a comma list right after a split one stays
    in one piece, as published scores have it; ``strict=False`` splits all.
    """
    return imported_names_of(import_groups(source), strict)
