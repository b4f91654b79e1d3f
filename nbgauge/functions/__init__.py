"""Cell metrics as Column expressions."""

from nbgauge.functions.code import (
    blank_cell,
    comment_lines,
    comment_words,
    display_outputs,
    exception_handlers,
    function_definitions,
    identifiers,
    identifiers_per_line,
    import_statements,
    imported_names,
    lines_of_code,
    max_identifier_length,
    mean_identifier_length,
    mean_line_length,
    nested_block_depth,
    operands,
    operators,
    parameters,
    result_outputs,
    statements,
    unique_operands,
    unique_operators,
)
from nbgauge.functions.complexity import cyclomatic_complexity
from nbgauge.functions.markdown import headers, markdown_lines, markdown_words

__all__ = [name for name in dir() if not name.startswith("_")]
