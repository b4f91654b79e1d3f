"""The same questions in DuckDB SQL: texts to check the Spark queries with."""

from __future__ import annotations

from nbgauge import schemas
from nbgauge.functions.code import KEYWORDS, OPERATORS
from workloads.views import VIEWS

NL = "chr(10)"
SPACE_CLASS = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def count_of(text: str, piece: str) -> str:
    size = len(piece)
    needle = NL if piece == "\n" else quoted(piece)
    return f"CAST((length({text}) - length(replace({text}, {needle}, ''))) // {size} AS BIGINT)"


def words_of(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^{SPACE_CLASS}]+'))"


def total_of(numbers: str) -> str:
    return f"CAST(coalesce(list_sum({numbers}), 0) AS BIGINT)"


def identifiers_of(text: str) -> str:
    words = ", ".join(quoted(k) for k in KEYWORDS)
    return f"list_filter(regexp_extract_all({text}, '[a-zA-Z_][a-zA-Z0-9_]*'), lambda w: w NOT IN ({words}))"


def code_metric_sql() -> dict[str, str]:
    """Metric name to an expression over ``source`` and ``output_type``."""
    loc = f"({count_of('source', chr(10))} + 1)"
    ids = identifiers_of("source")
    pieces = (
        r"list_filter(string_split_regex(source, '[\-()+*/=&|^~<>%]|!=|\n    (?:\*\*|>>|\+=|//=|==)'), "
        "lambda p: p <> '')"
    )
    per_line = (
        f"list_filter(list_transform(list_distinct(string_split(source, {NL})), "
        f"lambda l: len({identifiers_of('l')})), lambda n: n > 0)"
    )
    calls = r"regexp_extract_all(source, '[a-zA-Z_][a-zA-Z0-9_]*\([^)]*\)')"
    arguments = r"regexp_extract(c, '\(([^)\n]*)\)', 1)"
    return {
        "LOC": loc,
        "BLC": f"CAST({loc} = 0 AS BIGINT)",
        "UDF": f"CAST(len(list_filter(string_split(source, {NL}), "
        "lambda l: contains(l, 'def ') AND NOT starts_with(l, '#'))) AS BIGINT)",
        "I": count_of("source", "import "),
        "EH": count_of("source", "try:"),
        "ALLC": f"CAST((length(source) - ({loc} - 1)) AS DOUBLE) / {loc}",
        "NVD": f"coalesce({count_of('output_type', 'display_data')}, 0)",
        "NEC": f"coalesce({count_of('output_type', 'execute_result')}, 0)",
        "S": " + ".join(count_of("source", w) for w in ("while", "for", "if")),
        "P": rf"CASE WHEN len(list_filter({calls}, lambda c: NOT regexp_matches(c, '\([^)\n]*\)'))) > 0 THEN 0 ELSE "
        + total_of(f"list_transform({calls}, lambda c: len(string_split({arguments}, ',')))")
        + " END",
        "KLCID": f"coalesce(CAST(list_sum({per_line}) AS DOUBLE) / len({per_line}), 0)",
        "NBD": f"CAST({count_of('source', ' ')} AS DOUBLE) / {loc}",
        "OPRATOR": " + ".join(count_of("source", op) for op in OPERATORS),
        "OPRND": f"CAST(len({pieces}) AS BIGINT)",
        "UOPRND": f"CAST(len(list_distinct({pieces})) AS BIGINT)",
        "UOPRATOR": " + ".join(f"CAST(contains(source, {quoted(op)}) AS BIGINT)" for op in OPERATORS),
        "ID": f"CAST(len({ids}) AS BIGINT)",
        "ALID": f"coalesce({total_of(f'list_transform({ids}, lambda w: length(w))')} // nullif(len({ids}), 0), 0)",
        "MLID": f"coalesce(list_max(list_transform({ids}, lambda w: length(w))), 0)",
        # On the code-like cells: one `if` with one `and`, one loop and one handler at most.
        "CyC": "CAST(1 + "
        + " + ".join(count_of("source", p) for p in ("if a", " and ", "    for ", "except "))
        + " AS DOUBLE)",
        # No triple quotes in the code-like cells.
        "LOCom": r"CAST(len(regexp_extract_all(source, '#[^\n]+')) AS BIGINT)",
        "CW": total_of(rf"list_transform(regexp_extract_all(source, '#([^\n]+)', 1), lambda c: {words_of('c')})"),
    }


CODE_METRICS = code_metric_sql()

# Comma lists never follow each other in the code-like cells, so all are split.
IMPORTS = (
    r"list_transform(flatten(list_transform(regexp_extract_all(source, "
    r"'(?m)^\s*(?:from|import)\s+(\w+(?:\s*,\s*\w+)*)', 1), lambda g: string_split(g, ','))), lambda n: trim(n))"
)


def headers(level: int) -> str:
    mark = "#" * level + " "
    window = f"substr(source, i, {len(mark) + 1})"
    return (
        f"CAST(starts_with(source, {quoted(mark)}) AS BIGINT) + len([i for i in range(1, length(source) + 1) "
        f"IF {window} = {quoted(' ' + mark)} OR {window} = concat({NL}, {quoted(mark)})])"
    )


MARKDOWN_METRICS = {
    "LMC": f"({count_of('source', chr(10))} + 1)",
    **{f"H{level}": f"CAST({headers(level)} AS BIGINT)" for level in (1, 2, 3)},
    "MW": f"CAST({words_of('source')} AS BIGINT)",
}

FLOATS = ("ALLC", "KLCID", "NBD", "CyC", "EAP")


def rounded(expression: str, name: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) AS {name}"


def output(name: str, expression: str | None = None) -> str:
    value = expression or name
    return rounded(value, name) if name in FLOATS else f"CAST({value} AS BIGINT) AS {name}"


def cte(*parts: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in parts) + "\n"


def view(name: str) -> tuple[str, str]:
    return name, VIEWS[name][1]


def cell_metrics(source: str = "code_cells", *names: str) -> tuple[str, str]:
    chosen = names or tuple(CODE_METRICS)
    columns = ", ".join(f"{CODE_METRICS[n]} AS {n}" for n in chosen)
    return "cell_metrics", f"SELECT kernel_id, cell_index, {columns} FROM {source}"


def markdown_metrics(source: str = "markdown_cells") -> tuple[str, str]:
    columns = ", ".join(f"{e} AS {n}" for n, e in MARKDOWN_METRICS.items())
    return "md_metrics", f"SELECT kernel_id, cell_index, {columns} FROM {source}"


def cell_query(*names: str, source: str = "code_cells") -> str:
    columns = ", ".join(output(n, CODE_METRICS[n]) for n in names)
    return cte(view(source)) + f"SELECT kernel_id, cell_index, {columns} FROM {source}"


POPULARITY = (
    ("cell_imports", f"SELECT kernel_id, cell_index, {IMPORTS} AS names FROM code_cells"),
    ("api_n", "SELECT api, count(*) AS n FROM (SELECT unnest(names) AS api FROM cell_imports) GROUP BY api"),
    (
        "popularity",
        "SELECT api, n / (SELECT CAST(n AS DOUBLE) FROM api_n WHERE api = 'sklearn') AS score FROM api_n",
    ),
    (
        "cell_eap",
        "SELECT c.kernel_id, c.cell_index, coalesce(sum(p.score), 0) AS EAP FROM "
        "(SELECT kernel_id, cell_index, unnest(CASE WHEN len(names) = 0 THEN [NULL] ELSE list_distinct(names) END) AS api "
        "FROM cell_imports) c LEFT JOIN popularity p ON c.api = p.api GROUP BY c.kernel_id, c.cell_index",
    ),
)

# Cell metrics with EAP.
FULL_CELL_METRICS = (
    view("code_cells"),
    *POPULARITY,
    ("plain_metrics", cell_metrics()[1]),
    ("cell_metrics", "SELECT m.*, e.EAP FROM plain_metrics m JOIN cell_eap e USING (kernel_id, cell_index)"),
)


def code_aggregate(source: str = "cell_metrics", eap: bool = True) -> str:
    sums = [s for s in schemas.CODE_SUMS if eap or s != "EAP"]
    columns = (
        [f"sum({m}) AS {m}" for m in sums]
        + [f"avg({m}) AS {n}" for m, n in schemas.CODE_MEANS.items()]
        + [f"max({m}) AS {n}" for m, n in schemas.CODE_MAXIMA.items()]
        + ["count(LOC) AS CC"]
    )
    return f"SELECT kernel_id, {', '.join(columns)} FROM {source} WHERE kernel_id IS NOT NULL GROUP BY kernel_id"


def markdown_aggregate(source: str = "md_metrics") -> str:
    columns = (
        ["count(H1) AS MC"]
        + [f"avg({m}) AS {n}" for m, n in schemas.MARKDOWN_MEANS.items()]
        + [f"sum({m}) AS {m}" for m in schemas.MARKDOWN_SUMS]
    )
    return f"SELECT kernel_id, {', '.join(columns)} FROM {source} WHERE kernel_id IS NOT NULL GROUP BY kernel_id"


# Sums of doubles and all means are rounded on both sides.
NOTEBOOK_FLOATS = ("EAP", "ALID", "MeanLCC", "ALLC", "KLCID", "CyC", "NBD", "MeanWMC", "MeanLMC")


def notebook_columns(names, alias: str = "", zero: bool = False) -> str:
    found = []
    for n in names:
        value = f"{alias}{n}"
        value = f"coalesce({value}, 0)" if zero else value
        found.append(f"round(CAST({value} AS DOUBLE), 6) AS {n}" if n in NOTEBOOK_FLOATS else f"CAST({value} AS BIGINT) AS {n}")
    return ", ".join(found)


NOTEBOOK_METRICS = (
    *FULL_CELL_METRICS,
    ("code_agg", code_aggregate()),
    ("code_nb", "SELECT * FROM code_agg WHERE LOC > 1"),
    view("markdown_cells"),
    markdown_metrics(),
    ("md_nb", markdown_aggregate()),
    (
        "notebooks",
        "SELECT c.kernel_id, "
        + ", ".join(f"c.{n}" for n in schemas.CODE_NOTEBOOK_METRICS)
        + ", "
        + ", ".join(f"coalesce(m.{n}, 0) AS {n}" for n in schemas.MARKDOWN_NOTEBOOK_METRICS)
        + " FROM code_nb c LEFT JOIN md_nb m USING (kernel_id)",
    ),
)

# The study tables.
COMMENT_SCORES = (
    view("comments"),
    (
        "comment_totals",
        "SELECT KernelId, AuthorUserId, UserName, CurrentUrlSlug, TotalViews, TotalVotes, PerformanceTier_kerneluser, "
        "sum(CommentVote) AS CommentVote, CAST(sum(bert_score) AS DOUBLE) AS bert_score FROM comments "
        "GROUP BY ALL",
    ),
    (
        "comment_scores",
        "SELECT *, bert_score * (CommentVote + 1) AS pure_topic_score, "
        "(bert_score * (CommentVote + 1) + 10) / sqrt(TotalViews) AS topic_score FROM comment_totals",
    ),
)

FACTS = (
    view("kernels"),
    view("users"),
    (
        "authored",
        "SELECT k.*, u.UserName, u.PerformanceTier FROM kernels k JOIN users u ON k.AuthorUserId = u.Id",
    ),
    (
        "facts",
        "SELECT a.Id AS KernelId, a.TotalVotes, a.TotalViews, a.CurrentUrlSlug, a.UserName, a.PerformanceTier "
        "FROM authored a WHERE a.Id IN (SELECT DISTINCT l_orderkey FROM lineitem)",
    ),
)

AUGMENTED = (
    *COMMENT_SCORES,
    *FACTS,
    (
        "augmented",
        "SELECT coalesce(x.KernelId, y.KernelId) AS KernelId, "
        "coalesce(y.PerformanceTier, x.PerformanceTier_kerneluser) AS PerformanceTier_kerneluser, "
        "coalesce(x.topic_score, CASE WHEN y.TotalViews = 0 THEN CAST('inf' AS DOUBLE) ELSE 10 / sqrt(y.TotalViews) END) "
        "AS topic_score, coalesce(y.TotalViews, x.TotalViews) AS TotalViews, "
        "coalesce(y.TotalVotes, x.TotalVotes) AS TotalVotes, coalesce(y.UserName, x.UserName) AS UserName, "
        "coalesce(y.CurrentUrlSlug, x.CurrentUrlSlug) AS CurrentUrlSlug "
        "FROM comment_scores x FULL JOIN facts y ON x.KernelId = y.KernelId",
    ),
)

QUALITY = (
    *AUGMENTED,
    ("kept", "SELECT * FROM augmented WHERE TotalVotes < 500 AND topic_score < 5"),
    ("ends", "SELECT min(topic_score) AS t0, max(topic_score) AS t1, min(TotalVotes) AS v0, max(TotalVotes) AS v1 FROM kept"),
    (
        "quality",
        "SELECT *, score_scaled + vote_scaled AS combined_score FROM (SELECT k.*, "
        "(topic_score - t0) / (t1 - t0) AS score_scaled, CAST(TotalVotes - v0 AS DOUBLE) / (v1 - v0) AS vote_scaled "
        "FROM kept k, ends)",
    ),
)


def report_rows(source: str, label: str, prediction: str) -> tuple[tuple[str, str], ...]:
    """CTEs ending in ``report`` (class, precision, recall, f1, support)."""
    return (
        ("pairs", f"SELECT CAST({label} AS INT) AS t, CAST({prediction} AS INT) AS p FROM {source}"),
        ("labels_seen", "SELECT t AS c FROM pairs UNION SELECT p FROM pairs"),
        (
            "counted",
            "SELECT c, (SELECT count(*) FROM pairs WHERE t = c) AS support, (SELECT count(*) FROM pairs WHERE p = c) AS predicted, "
            "(SELECT count(*) FROM pairs WHERE p = c AND t = c) AS hits FROM labels_seen",
        ),
        (
            "per_class",
            "SELECT c, support, hits, CASE WHEN predicted = 0 THEN 0 ELSE CAST(hits AS DOUBLE) / predicted END AS precision, "
            "CASE WHEN support = 0 THEN 0 ELSE CAST(hits AS DOUBLE) / support END AS recall, "
            "CASE WHEN support + predicted = 0 THEN 0 ELSE 2.0 * hits / (support + predicted) END AS f1 FROM counted",
        ),
        (
            "report",
            "SELECT CAST(c AS VARCHAR) AS class, precision, recall, f1, support FROM per_class "
            "UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT CAST(sum(hits) AS DOUBLE) / sum(support) AS a, sum(support) AS n FROM per_class) "
            "UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per_class "
            "UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), "
            "sum(f1 * support) / sum(support), sum(support) FROM per_class",
        ),
    )


REPORT_COLUMNS = (
    "class, round(CAST(precision AS DOUBLE), 6) AS precision, round(CAST(recall AS DOUBLE), 6) AS recall, "
    "round(CAST(f1 AS DOUBLE), 6) AS f1, CAST(support AS BIGINT) AS support"
)
