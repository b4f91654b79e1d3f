"""Fixed schemas of the tables the library reads and writes, as DDL texts."""

from __future__ import annotations

CODE_CELLS = (
    "kernel_id STRING, cell_index INT, source STRING, output_type STRING, execution_count INT"
)
MARKDOWN_CELLS = "kernel_id STRING, cell_index INT, source STRING"

CODE_CELL_METRICS = (
    "kernel_id STRING, cell_index INT, API ARRAY<STRING>, EAP DOUBLE, LOC BIGINT, BLC BIGINT, UDF BIGINT, "
    "I BIGINT, EH BIGINT, ALLC DOUBLE, NVD BIGINT, NEC BIGINT, S BIGINT, P BIGINT, KLCID DOUBLE, NBD DOUBLE, "
    "OPRATOR BIGINT, OPRND BIGINT, UOPRND BIGINT, UOPRATOR BIGINT, ID BIGINT, ALID BIGINT, MLID BIGINT, "
    "CyC DOUBLE, LOCom BIGINT, CW BIGINT"
)
MARKDOWN_CELL_METRICS = (
    "kernel_id STRING, cell_index INT, LMC BIGINT, H1 BIGINT, H2 BIGINT, H3 BIGINT, MW BIGINT"
)
CODE_CELL_COLUMNS = tuple(column.split(" ")[0] for column in CODE_CELL_METRICS.split(", "))

API_POPULARITY = "api STRING, score DOUBLE"
USER_PT = "Id_x BIGINT, PerformanceTier INT"
NOTEBOOK_SCORES = (
    "KernelId BIGINT, TotalViews BIGINT, TotalVotes BIGINT, PerformanceTier_kerneluser INT, "
    "topic_score DOUBLE, score_scaled DOUBLE, vote_scaled DOUBLE, combined_score DOUBLE"
)
EXPERT_SCORES = "KernelId BIGINT, expert_score INT"
RATERS = (
    "KernelId BIGINT, label INT, `Expert 1` INT, `Expert 2` INT, `Expert 3` INT, expert_score INT"
)
COMMENTS = (
    "KernelId BIGINT, CommentId BIGINT, Text STRING, Message STRING, DisplayName_kerneluser STRING, "
    "DisplayName_commentuser STRING, AuthorUserId BIGINT, UserName STRING, CurrentUrlSlug STRING, "
    "TotalViews BIGINT, TotalVotes BIGINT, PerformanceTier_kerneluser INT, CommentVote BIGINT, bert_score DOUBLE"
)
KERNELS = (
    "Id BIGINT, AuthorUserId BIGINT, TotalVotes BIGINT, TotalViews BIGINT, CurrentUrlSlug STRING"
)
USERS = "Id BIGINT, UserName STRING, PerformanceTier INT"
USER_ACHIEVEMENTS = (
    "UserId BIGINT, AchievementType STRING, Tier INT, TierAchievementDate STRING"
)
NOTEBOOK_TEXT = "KernelId BIGINT, code STRING, markdown STRING, label INT, score DOUBLE"

# Aggregates of the cells of a notebook, by aggregate, with the published names in table order.
CODE_SUMS = (
    "LOC", "BLC", "UDF", "I", "EH", "NVD", "NEC", "S", "P", "OPRND", "OPRATOR", "UOPRND", "UOPRATOR",
    "ID", "LOCom", "EAP", "CW",
)
CODE_MEANS = {"ALID": "ALID", "LOC": "MeanLCC", "ALLC": "ALLC", "KLCID": "KLCID", "CyC": "CyC"}
CODE_MAXIMA = {"MLID": "MLID", "NBD": "NBD", "ID": "AID"}
MARKDOWN_MEANS = {"MW": "MeanWMC", "LMC": "MeanLMC"}
MARKDOWN_SUMS = "H1", "H2", "H3", "MW", "LMC"

CODE_NOTEBOOK_METRICS = (*CODE_SUMS, *CODE_MEANS.values(), *CODE_MAXIMA.values(), "CC")
MARKDOWN_NOTEBOOK_METRICS = ("MC", *MARKDOWN_MEANS.values(), *MARKDOWN_SUMS)
NOTEBOOK_METRICS = (*CODE_NOTEBOOK_METRICS, *MARKDOWN_NOTEBOOK_METRICS)
