"""The driver's tables seen as notebook tables.

Each text is plain SQL that gives the same rows in Spark and in DuckDB: the
queries run it through Spark, the checks put it in front of their SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, tuple[str, str]] = {}

# Code-like cells: the text is put together from fragments chosen per row.
VIEWS["code_cells"] = ("lineitem", """
SELECT l_orderkey AS kernel_id,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity,
                          l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS cell_index,
       concat(
         CASE l_partkey % 5 WHEN 0 THEN concat('import numpy, pandas', chr(10)) WHEN 1 THEN concat('import sklearn', chr(10))
              WHEN 2 THEN concat('from os.path import join', chr(10))
              WHEN 3 THEN concat('import torch', chr(10), 'import sklearn', chr(10)) ELSE '' END,
         CASE l_suppkey % 4
              WHEN 0 THEN concat('def f', l_linenumber, '(x, y=', l_linenumber, '):', chr(10), '    return x ** 2 + y', chr(10))
              WHEN 1 THEN concat('# keep ', l_returnflag, ' rows', chr(10))
              WHEN 2 THEN concat('if a == ', l_suppkey, ' and b != 2:', chr(10), '    total += g(a, b)', chr(10))
              ELSE concat('try:', chr(10), '    for i in range(', l_linenumber, '):', chr(10), '        h(i,', chr(10),
                          '          2)', chr(10), 'except ValueError:', chr(10), '    pass', chr(10)) END,
         'value_', lower(l_linestatus), ' = ', l_partkey) AS source,
       CASE l_linenumber % 3 WHEN 0 THEN 'display_data' WHEN 1 THEN 'execute_result' END AS output_type
FROM lineitem""")

# Natural text as cells of fifty notebooks.
VIEWS["text_cells"] = ("documents", """
SELECT doc_id % 50 AS kernel_id, doc_id AS cell_index, text AS source, CAST(NULL AS VARCHAR(20)) AS output_type
FROM documents""")

VIEWS["markdown_cells"] = ("conversations", """
SELECT conv_id AS kernel_id, turn AS cell_index,
       concat(CASE turn % 3 WHEN 0 THEN '# ' WHEN 1 THEN '## ' ELSE '' END, text) AS source
FROM conversations WHERE role <> 'assistant'""")

# Cell ids as a raw dump holds them: a marker row and ids that are no numbers.
VIEWS["raw_code_cells"] = ("conversations", """
SELECT CASE WHEN conv_id % 9 = 4 THEN 'train_emb' WHEN conv_id % 9 = 5 THEN concat(conv_id, '.0')
            WHEN conv_id % 9 = 6 THEN NULL ELSE concat('', conv_id) END AS kernel_id,
       turn AS cell_index, text AS source, CAST(NULL AS VARCHAR(20)) AS output_type
FROM conversations WHERE role = 'assistant'""")

VIEWS["kernels"] = ("orders", """
SELECT o_orderkey AS Id, o_custkey AS AuthorUserId, o_orderkey % 600 AS TotalVotes,
       CAST(floor(o_totalprice) AS BIGINT) % 5000 AS TotalViews, concat('slug-', o_orderkey) AS CurrentUrlSlug
FROM orders""")

VIEWS["users"] = ("customer", """
SELECT c_custkey AS Id, c_name AS UserName, CAST(c_custkey % 6 AS INT) AS PerformanceTier FROM customer""")

VIEWS["user_achievements"] = ("customer", """
SELECT c_custkey AS UserId, c_mktsegment AS AchievementType, CAST(c_nationkey % 5 AS INT) AS Tier FROM customer""")

VIEWS["comments"] = ("events", """
SELECT user_id AS KernelId, event_id AS CommentId, concat('u', user_id % 10) AS DisplayName_kerneluser,
       CASE WHEN event_id % 50 = 0 THEN NULL ELSE concat('u', event_id % 10) END AS DisplayName_commentuser,
       CASE WHEN event_id % 33 = 0 THEN NULL ELSE repeat(props, CAST(event_id % 40 AS INT)) END AS Text,
       CASE WHEN event_id % 11 = 0 THEN concat('<a href=', event_type, '>') ELSE event_type END AS Message,
       event_id % 7 AS CommentVote, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS bert_score,
       user_id % 37 AS AuthorUserId, concat('name', user_id % 37) AS UserName, concat('slug-', user_id) AS CurrentUrlSlug,
       1 + user_id * 13 % 5000 AS TotalViews, user_id % 600 AS TotalVotes,
       CAST(user_id % 6 AS INT) AS PerformanceTier_kerneluser
FROM events""")

VIEWS["expert_scores"] = ("labels", """
SELECT doc_id AS KernelId, quality AS expert_score FROM labels""")

VIEWS["raters"] = ("labels", """
SELECT doc_id AS KernelId, quality AS expert_1, toxic AS expert_2,
       CASE WHEN doc_id % 40 = 7 THEN NULL ELSE CAST((quality + doc_id) % 2 AS INT) END AS expert_3
FROM labels""")


def source_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files, whether it is one file or a folder of them."""
    # A pattern that fits this name only: a stream takes a plain path for a folder.
    return spark.readStream.schema(source_table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One notebook table, planned over the driver's parquet."""
    base, text = VIEWS[name]
    head, tail = text.rsplit(f"FROM {base}", 1)
    return spark.sql(f"{head}FROM {{{base}}}{tail}", **{base: source_table(spark, sf_dir, base)})
