"""Queries over comments, kernels and scores: cleaning, selection, ranks and statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nbgauge.operators import cleaning, evaluation, ordering
from nbgauge.operators.notebook import apply_filters
from nbgauge.operators.scores import (
    comment_scores,
    drop_outliers,
    kernels_with_author,
    with_url,
    with_votes_per_view,
)
from nbgauge.plans import quality as plans
from workloads import sql
from workloads.registry import collection
from workloads.views import source_table, view

QUERIES, ORACLES, query = collection()


def r6(*names: str):
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def longs(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def sql_r6(*names: str) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)


def sql_longs(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


# -- comments -----------------------------------------------------------------


@query(
    sql.cte(sql.view("comments"))
    + "SELECT KernelId, CommentId, Text FROM comments WHERE coalesce(DisplayName_kerneluser <> DisplayName_commentuser, true) "
    "AND length(Text) <= 256 AND NOT contains(Message, '<a')"
)
def comments_cleaned(spark, sf_dir):
    return cleaning.clean_comments(view(spark, sf_dir, "comments")).select("KernelId", "CommentId", "Text")


@query("SELECT doc_id FROM documents WHERE NOT (doc_id % 100 > 70 AND NOT contains(lang, 'en'))")
def comments_in_language(spark, sf_dir):
    rows = source_table(spark, sf_dir, "documents").withColumn("lang_conf", (F.col("doc_id") % 100).cast("double") / 100)
    return cleaning.in_language(rows).select("doc_id")


@query(
    "SELECT doc_id, CASE WHEN contains(replace(text, chr(10), ' '), ' the ') THEN 'en' ELSE 'xx' END AS lang, CAST(0.9 AS DOUBLE) AS lang_conf FROM documents"
)
def comments_language_detector(spark, sf_dir):
    """The slot for a language detector, with a detector of one word."""

    def detect(texts: pd.Series) -> pd.DataFrame:
        english = texts.str.contains(" the ", regex=False)
        return pd.DataFrame({"lang": english.map({True: "en", False: "xx"}), "lang_conf": 0.9})

    rows = source_table(spark, sf_dir, "documents").select("doc_id", "text")
    return cleaning.with_language(rows, detect, "text").drop("text")


@query(
    "SELECT doc_id AS Id, text AS Text, CAST(quality = 1 AS BIGINT) AS label FROM documents JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) <> 1"
)
def topic_labels(spark, sf_dir):
    sheet = source_table(spark, sf_dir, "documents").join(source_table(spark, sf_dir, "labels"), "doc_id")
    sheet = sheet.select(F.col("doc_id").alias("Id"), F.col("text").alias("Text"), F.col("toxic").alias("advertise"), F.col("quality").alias("topic"))
    return cleaning.topic_label(sheet, "topic", "advertise").withColumn("label", F.col("label").cast("bigint"))


SCORED = ("CommentVote", "bert_score", "pure_topic_score", "topic_score")


@query(sql.cte(*sql.COMMENT_SCORES) + f"SELECT KernelId, AuthorUserId, UserName, {sql_r6(*SCORED)} FROM comment_scores")
def comment_topic_scores(spark, sf_dir):
    scored = comment_scores(view(spark, sf_dir, "comments"))
    return scored.select("KernelId", "AuthorUserId", "UserName", *r6(*SCORED))


# -- kernels and quality ------------------------------------------------------


def facts(spark, sf_dir) -> DataFrame:
    features = view(spark, sf_dir, "code_cells").select("kernel_id")
    return plans.kernel_facts(features, view(spark, sf_dir, "kernels"), view(spark, sf_dir, "users"))


def augmented(spark, sf_dir) -> DataFrame:
    return plans.augmented_quality(view(spark, sf_dir, "comments"), facts(spark, sf_dir))


def kernel_quality(spark, sf_dir) -> DataFrame:
    return plans.kernel_quality(view(spark, sf_dir, "comments"), facts(spark, sf_dir))


@query(
    sql.cte(*sql.FACTS)
    + f"SELECT AuthorUserId, Id, CurrentUrlSlug, UserName, {sql_longs('TotalVotes', 'TotalViews', 'PerformanceTier')} FROM authored"
)
def kernel_authors(spark, sf_dir):
    rows = kernels_with_author(view(spark, sf_dir, "kernels"), view(spark, sf_dir, "users"))
    return rows.select("AuthorUserId", "Id", "CurrentUrlSlug", "UserName", *longs("TotalVotes", "TotalViews", "PerformanceTier"))


@query(
    sql.cte(*sql.FACTS)
    + f"SELECT KernelId AS kernel_id, CurrentUrlSlug, UserName, {sql_longs('TotalVotes', 'TotalViews', 'PerformanceTier')} FROM facts"
)
def kernels_measured(spark, sf_dir):
    return facts(spark, sf_dir).select("kernel_id", "CurrentUrlSlug", "UserName", *longs("TotalVotes", "TotalViews", "PerformanceTier"))


AUGMENTED = ("TotalViews", "TotalVotes", "PerformanceTier_kerneluser")


@query(
    sql.cte(*sql.AUGMENTED)
    + f"SELECT KernelId, UserName, CurrentUrlSlug, {sql_longs(*AUGMENTED)}, round(topic_score, 6) AS topic_score FROM augmented"
)
def quality_augmented(spark, sf_dir):
    return augmented(spark, sf_dir).select("KernelId", "UserName", "CurrentUrlSlug", *longs(*AUGMENTED), *r6("topic_score"))


@query(sql.cte(*sql.QUALITY) + f"SELECT KernelId, TotalVotes, TotalViews, {sql_r6('topic_score')} FROM kept")
def quality_without_outliers(spark, sf_dir):
    return drop_outliers(augmented(spark, sf_dir)).select("KernelId", *longs("TotalVotes", "TotalViews"), *r6("topic_score"))


SCALED = ("topic_score", "score_scaled", "vote_scaled", "combined_score")


@query(sql.cte(*sql.QUALITY) + f"SELECT KernelId, {sql_longs(*AUGMENTED)}, {sql_r6(*SCALED)} FROM quality")
def quality_scaled(spark, sf_dir):
    return kernel_quality(spark, sf_dir).select("KernelId", *longs(*AUGMENTED), *r6(*SCALED))


@query(
    sql.cte(*sql.QUALITY)
    + "SELECT KernelId, concat('https://www.kaggle.com/code/', UserName, '/', CurrentUrlSlug, '/notebook') AS url, "
    "round((TotalVotes + 1) / CAST(TotalViews AS DOUBLE), 6) AS score FROM kept WHERE TotalViews >= 500"
)
def quality_urls(spark, sf_dir):
    rows = apply_filters(drop_outliers(augmented(spark, sf_dir)), cleaning.SCORES_FILTERS["default"])
    return with_url(with_votes_per_view(rows)).select("KernelId", "url", *r6("score"))


# -- cleaning -----------------------------------------------------------------


def raw_features(spark, sf_dir) -> DataFrame:
    """A feature table as a dump holds it: repeated rows, texts, broken rows."""
    rows = source_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("kernel_id"),
        (F.col("o_orderkey") * 7 % 1500).cast("string").alias("LOC"),
        F.when(F.col("o_custkey") % 10 == 0, "Unnamed: 27").otherwise((F.col("o_custkey") % 9).cast("string")).alias("MC"),
        F.when(F.col("o_orderkey") % 13 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("ALLC"),
        F.when(F.col("o_orderkey") % 2 == 0, "ML").otherwise("other").alias("TYPE"),
        F.col("o_custkey").alias("NVD"),
        F.lit(1).alias("PT"),
    )
    return rows.unionByName(rows)


FEATURES = (
    "SELECT o_orderkey AS KernelId, CAST(o_orderkey * 7 % 1500 AS DOUBLE) AS LOC, CAST(o_custkey % 9 AS DOUBLE) AS MC, "
    "o_totalprice AS ALLC, CASE o_orderkey % 2 WHEN 0 THEN 'ML' ELSE 'other' END AS TYPE, CAST(o_custkey AS DOUBLE) AS NVD, "
    "CAST(1 AS DOUBLE) AS PT FROM orders WHERE o_custkey % 10 <> 0 AND o_orderkey % 13 <> 0"
)


@query(f"SELECT * FROM ({FEATURES})")
def features_cleaned(spark, sf_dir):
    return cleaning.clean_features(raw_features(spark, sf_dir))


@query(f"SELECT * FROM ({FEATURES}) WHERE TYPE = 'ML' AND LOC < 1000")
def features_filtered(spark, sf_dir):
    return apply_filters(cleaning.clean_features(raw_features(spark, sf_dir)), cleaning.METRICS_FILTERS["ML_based"])


@query(f"SELECT LOC, MC, ALLC AS ALLCL, NVD AS VDT FROM ({FEATURES}) WHERE LOC < 1000")
def features_projected(spark, sf_dir):
    rows = apply_filters(cleaning.clean_features(raw_features(spark, sf_dir)), cleaning.METRICS_FILTERS["default"])
    return cleaning.rename_short(cleaning.features_only(rows, include_pt=False))


@query(
    "SELECT o_orderkey AS kernel_id, CAST(o_orderkey * 7 % 1500 AS DOUBLE) AS LOC, CAST(o_custkey % 9 AS DOUBLE) AS MC, o_custkey AS NVD "
    "FROM orders WHERE o_custkey % 10 <> 0 AND o_orderkey % 13 <> 0"
)
def features_repaired(spark, sf_dir):
    rows = cleaning.drop_broken_rows(cleaning.distinct_complete_rows(raw_features(spark, sf_dir)))
    return cleaning.text_columns_to_double(rows, keep=("TYPE",), strict=True).drop("ALLC", "TYPE", "PT")


@query(
    sql.cte(*sql.QUALITY)
    + f"SELECT KernelId, {sql_longs('TotalViews', 'TotalVotes')}, {sql_r6('combined_score')} FROM quality WHERE TotalViews >= 500"
)
def scores_cleaned(spark, sf_dir):
    quality = kernel_quality(spark, sf_dir)
    rows = cleaning.clean_scores(quality.unionByName(quality))
    rows = apply_filters(rows, cleaning.SCORES_FILTERS["default"])
    return rows.select("KernelId", *longs("TotalViews", "TotalVotes"), *r6("combined_score"))


@query("SELECT DISTINCT doc_id AS KernelId, CAST(quality AS BIGINT) AS expert_score FROM labels WHERE doc_id % 5 <> 0")
def experts_cleaned(spark, sf_dir):
    rows = view(spark, sf_dir, "expert_scores").withColumn(
        "expert_score", F.when(F.col("KernelId") % 5 == 0, "n/a").otherwise(F.col("expert_score").cast("string"))
    )
    return cleaning.clean_experts(rows).select("KernelId", *longs("expert_score"))


@query(
    "SELECT doc_id AS KernelId, text AS code, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END, '') AS markdown FROM documents WHERE doc_id % 7 <> 0"
)
def texts_completed(spark, sf_dir):
    rows = source_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("KernelId"),
        F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("code"),
        F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("markdown"),
    )
    return cleaning.complete_texts(rows)


# -- order, selection, samples ------------------------------------------------


# Many equal votes, so that ties are decided by the id.
RANKED = "row_number() OVER (ORDER BY TotalVotes NULLS LAST, Id) AS r, count(*) OVER () AS n"


@query(sql.cte(sql.view("kernels")) + f"SELECT Id, TotalVotes, r AS rank FROM (SELECT *, {RANKED} FROM kernels)")
def global_rank(spark, sf_dir):
    return ordering.with_global_rank(view(spark, sf_dir, "kernels").select("Id", "TotalVotes"), "TotalVotes", "Id")


@query(sql.cte(sql.view("kernels")) + "SELECT Id, TotalVotes FROM kernels")
def sorted_by_score(spark, sf_dir):
    return ordering.sorted_by(view(spark, sf_dir, "kernels").select("Id", "TotalVotes"), "TotalVotes", "Id")


@query(
    "SELECT c_custkey AS UserId, c_mktsegment AS AchievementType, c_nationkey % 5 AS Tier FROM customer"
)
def achievements_sorted(spark, sf_dir):
    return ordering.sorted_by(view(spark, sf_dir, "user_achievements"), "Tier", "UserId").withColumn("Tier", F.col("Tier").cast("int"))


def labelled_ends(low: str, high: str) -> str:
    return (
        sql.cte(sql.view("kernels"))
        + f"SELECT Id, TotalVotes, CAST(CASE WHEN r <= {low} THEN 0 ELSE 1 END AS BIGINT) AS label FROM (SELECT *, {RANKED} FROM kernels) "
        f"WHERE r <= {low} OR r > n - {high}"
    )


def with_long_label(df: DataFrame) -> DataFrame:
    return df.select("Id", "TotalVotes", *longs("label"))


@query(labelled_ends("floor(0.25::DOUBLE * 0.7::DOUBLE * n)", "floor(0.25::DOUBLE * (1 - 0.7::DOUBLE) * n)"))
def select_extremes(spark, sf_dir):
    return with_long_label(ordering.select_extremes(view(spark, sf_dir, "kernels"), "TotalVotes", id_col="Id"))


@query(labelled_ends("floor(0.1::DOUBLE * n)", "floor(0.1::DOUBLE * n)"))
def select_symmetric(spark, sf_dir):
    return with_long_label(ordering.select_symmetric(view(spark, sf_dir, "kernels"), 0.1, "TotalVotes", "Id"))


@query(
    sql.cte(sql.view("kernels"))
    + f"SELECT Id, TotalVotes, CAST(r > floor(0.5::DOUBLE * n) AS BIGINT) AS label FROM (SELECT *, {RANKED} FROM kernels)"
)
def median_split(spark, sf_dir):
    return with_long_label(ordering.split_at_rank(view(spark, sf_dir, "kernels"), "TotalVotes", 0.5, id_col="Id"))


@query(
    sql.cte(*sql.QUALITY, ("seen", "SELECT KernelId, (TotalVotes + 1) / CAST(TotalViews AS DOUBLE) AS score FROM quality WHERE TotalViews >= 500"))
    + "SELECT KernelId, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY score, KernelId) AS r, count(*) OVER () AS n FROM seen) "
    "WHERE r <= 100 OR r > n - 100"
)
def head_and_tail(spark, sf_dir):
    return plans.text_model_sample(kernel_quality(spark, sf_dir), 200).select("KernelId", *r6("score"))


@query(
    sql.cte(sql.view("expert_scores"))
    + "SELECT KernelId, expert_score FROM (SELECT *, row_number() OVER (PARTITION BY expert_score ORDER BY KernelId) AS r FROM expert_scores) "
    "WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM expert_scores GROUP BY expert_score))"
)
def balanced_head(spark, sf_dir):
    return ordering.balanced_head(view(spark, sf_dir, "expert_scores"))


@query(sql.cte(sql.view("expert_scores")) + "SELECT expert_score, count(*) AS n FROM expert_scores GROUP BY expert_score")
def class_counts(spark, sf_dir):
    return ordering.class_counts(view(spark, sf_dir, "expert_scores"), "expert_score")


@query(
    "SELECT doc_id AS KernelId, text AS Text FROM documents ORDER BY doc_id LIMIT (SELECT count(*) FROM labels)"
)
def cut_to_length(spark, sf_dir):
    rows = source_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("KernelId"), F.col("text").alias("Text"))
    return ordering.first_rows(rows, view(spark, sf_dir, "expert_scores"))


def shuffled(seed: int, id_col: str = "Id") -> str:
    return f"substr(md5(concat({seed}, ':', {id_col})), 1, 16)"


@query(sql.cte(sql.view("kernels")) + f"SELECT Id, AuthorUserId FROM kernels ORDER BY {shuffled(42)}, Id LIMIT 525")
def random_sample(spark, sf_dir):
    return ordering.sample_rows(view(spark, sf_dir, "kernels"), 525, "Id").select("Id", "AuthorUserId")


@query(
    sql.cte(sql.view("kernels"))
    + "SELECT Id, CASE WHEN r <= ceil(0.1::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM "
    f"(SELECT Id, row_number() OVER (ORDER BY {shuffled(42)}, Id) AS r, count(*) OVER () AS n FROM kernels)"
)
def random_split(spark, sf_dir):
    return ordering.random_split(view(spark, sf_dir, "kernels"), 0.1, "Id").select("Id", "split")


@query(
    sql.cte(
        sql.view("kernels"),
        ("o", f"SELECT Id, row_number() OVER (ORDER BY {shuffled(1)}, Id) AS r, count(*) OVER () AS n FROM kernels"),
        ("rest", f"SELECT Id, row_number() OVER (ORDER BY {shuffled(2)}, Id) AS r, count(*) OVER () AS n FROM o WHERE r > ceil(0.13::DOUBLE * n)"),
    )
    + "SELECT Id, 'eval' AS split FROM o WHERE r <= ceil(0.13::DOUBLE * n) UNION ALL "
    "SELECT Id, CASE WHEN r <= ceil(0.25::DOUBLE * n) THEN 'test' ELSE 'train' END FROM rest"
)
def three_way_split(spark, sf_dir):
    return ordering.three_way_split(view(spark, sf_dir, "kernels"), id_col="Id").select("Id", "split")


# Every row twice: a cut may run through two equal rows.
DOUBLED = sql.cte(sql.view("kernels"), ("twice", "SELECT * FROM kernels UNION ALL SELECT * FROM kernels"))


def doubled(spark, sf_dir) -> DataFrame:
    rows = view(spark, sf_dir, "kernels")
    return rows.unionAll(rows)


@query(
    DOUBLED + f"SELECT Id, TotalVotes, CAST(CASE WHEN r <= floor(0.25::DOUBLE * 0.7::DOUBLE * n) THEN 0 ELSE 1 END AS BIGINT) AS label FROM (SELECT *, {RANKED} FROM twice) "
    "WHERE r <= floor(0.25::DOUBLE * 0.7::DOUBLE * n) OR r > n - floor(0.25::DOUBLE * (1 - 0.7::DOUBLE) * n)"
)
def select_extremes_repeated(spark, sf_dir):
    return with_long_label(ordering.select_extremes(doubled(spark, sf_dir), "TotalVotes", id_col="Id"))


@query(DOUBLED + f"SELECT Id, TotalVotes, CAST(r > floor(0.25::DOUBLE * n) AS BIGINT) AS label FROM (SELECT *, {RANKED} FROM twice)")
def rank_split_repeated(spark, sf_dir):
    return with_long_label(ordering.split_at_rank(doubled(spark, sf_dir), "TotalVotes", 0.25, id_col="Id"))


@query(
    DOUBLED + "SELECT Id, CASE WHEN r <= ceil(0.1::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM "
    f"(SELECT Id, row_number() OVER (ORDER BY {shuffled(42)}, Id) AS r, count(*) OVER () AS n FROM twice)"
)
def random_split_repeated(spark, sf_dir):
    return ordering.random_split(doubled(spark, sf_dir), 0.1, "Id").select("Id", "split")


@query(DOUBLED + "SELECT Id, TotalVotes FROM twice ORDER BY Id LIMIT (SELECT count(*) FROM labels)")
def first_rows_repeated(spark, sf_dir):
    return ordering.first_rows(doubled(spark, sf_dir), view(spark, sf_dir, "expert_scores"), "Id").select("Id", "TotalVotes")


SAMPLED = (
    *sql.QUALITY,
    ("seen", "SELECT KernelId, UserName, CurrentUrlSlug, row_number() OVER (ORDER BY combined_score, KernelId) AS r, count(*) OVER () AS n FROM quality WHERE TotalViews > 500"),
    ("ends_of", "SELECT *, CASE WHEN r <= floor(0.1::DOUBLE * n) THEN 0 ELSE 1 END AS label FROM seen WHERE r <= floor(0.1::DOUBLE * n) OR r > n - floor(0.1::DOUBLE * n)"),
    ("drawn", f"SELECT *, row_number() OVER (PARTITION BY label ORDER BY {shuffled(42, 'KernelId')}, KernelId) AS d FROM ends_of"),
)


@query(
    sql.cte(*SAMPLED)
    + "SELECT KernelId, CAST(label AS BIGINT) AS label, concat('https://www.kaggle.com/code/', UserName, '/', CurrentUrlSlug, '/notebook') AS url FROM drawn WHERE d <= 100"
)
def expert_sample(spark, sf_dir):
    rows = plans.expert_sample(kernel_quality(spark, sf_dir), per_class=100)
    return rows.select("KernelId", *longs("label"), "url")


@query(
    "SELECT doc_id AS KernelId, text AS code, CAST(0 AS BIGINT) AS label FROM documents UNION ALL "
    "SELECT page_id, html, 1 FROM pages"
)
def labelled_union(spark, sf_dir):
    zeros = source_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("KernelId"), F.col("text").alias("code"))
    ones = source_table(spark, sf_dir, "pages").select(F.col("page_id").alias("KernelId"), F.col("html").alias("code"))
    rows = ordering.union_labelled([(zeros, 0), (ones, 1)])
    return rows.withColumn("label", F.col("label").cast("bigint"))


# -- statistics ---------------------------------------------------------------


def kappa_sql(share: str) -> str:
    return (
        sql.cte(
            sql.view("raters"),
            ("v", "SELECT expert_1 + expert_2 + expert_3 AS ones FROM raters WHERE expert_1 IS NOT NULL AND expert_2 IS NOT NULL AND expert_3 IS NOT NULL"),
            ("c", "SELECT ones AS c1, 3 - ones AS c0 FROM v"),
            ("s", f"SELECT count(*) AS n, avg((c1 * c1 + c0 * c0 - 3) / 6.0) AS observed, {share} FROM c"),
            ("e", "SELECT n, CAST(observed AS DOUBLE) AS observed, p0 * p0 + p1 * p1 AS expected FROM s"),
        )
        + "SELECT n, round(observed, 6) AS observed, round(expected, 6) AS expected, round((observed - expected) / (1 - expected), 6) AS kappa FROM e"
    )


def kappa(spark, sf_dir, standard):
    raters = ["expert_1", "expert_2", "expert_3"]
    found = evaluation.fleiss_kappa(view(spark, sf_dir, "raters"), raters, standard=standard)
    return found.select("n", *r6("observed", "expected", "kappa"))


@query(
    kappa_sql(
        "CAST(count(*) FILTER (WHERE c0 = 3) AS DOUBLE) / (count(*) * 3) AS p0, CAST(count(*) FILTER (WHERE c1 = 3) AS DOUBLE) / (count(*) * 3) AS p1"
    )
)
def fleiss_kappa(spark, sf_dir):
    return kappa(spark, sf_dir, False)


@query(kappa_sql("CAST(sum(c0) AS DOUBLE) / (count(*) * 3) AS p0, CAST(sum(c1) AS DOUBLE) / (count(*) * 3) AS p1"))
def fleiss_kappa_standard(spark, sf_dir):
    return kappa(spark, sf_dir, True)


def report(df: DataFrame) -> DataFrame:
    return df.select("class", *r6("precision", "recall", "f1"), *longs("support"))


@query(sql.cte(*sql.report_rows("labels", "quality", "toxic")) + f"SELECT {sql.REPORT_COLUMNS} FROM report")
def classification_report(spark, sf_dir):
    return report(evaluation.classification_report(source_table(spark, sf_dir, "labels"), "quality", "toxic"))


def _criterion(name: str):
    oracle = (
        sql.cte(
            *sql.QUALITY,
            sql.view("expert_scores"),
            # Scores are compared as computed; the last bits differ between engines.
            ("halves", f"SELECT KernelId, row_number() OVER (ORDER BY round({name}, 9), KernelId) > floor(0.5::DOUBLE * count(*) OVER ()) AS high FROM quality"),
            ("judged", "SELECT h.high::INT AS high, e.expert_score FROM halves h JOIN expert_scores e USING (KernelId)"),
            *sql.report_rows("judged", "expert_score", "high"),
        )
        + f"SELECT {sql.REPORT_COLUMNS} FROM report"
    )

    def run(spark, sf_dir):
        quality = kernel_quality(spark, sf_dir).withColumn(name, F.round(name, 9))
        return report(evaluation.criterion_report(quality, view(spark, sf_dir, "expert_scores"), name))

    run.__name__ = f"expert_report_{name}"
    query(oracle)(run)


_criterion("topic_score")
_criterion("vote_scaled")
_criterion("combined_score")


@query(
    "WITH s AS (SELECT CAST(n_chars AS DOUBLE) AS s, quality AS y FROM documents JOIN labels USING (doc_id)), "
    "p AS (SELECT (SELECT count(*) FROM s WHERE y = 1) AS n1, (SELECT count(*) FROM s WHERE y = 0) AS n0, "
    "(SELECT sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) FROM s a, s b WHERE a.y = 1 AND b.y = 0) AS u) "
    "SELECT n1 AS positives, n0 AS negatives, round(CAST(u AS DOUBLE) / (n1 * n0), 6) AS roc_auc FROM p"
)
def roc_auc(spark, sf_dir):
    scored = source_table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(source_table(spark, sf_dir, "labels"), "doc_id")
    return evaluation.roc_auc(scored, "quality", "n_chars").select("positives", "negatives", *r6("roc_auc"))


@query(
    "SELECT round(avg(CAST(quality = toxic AS INT)), 6) AS accuracy, "
    "round(CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS DOUBLE) / count(*) FILTER (WHERE quality = 1), 6) AS recall FROM labels"
)
def accuracy_and_recall(spark, sf_dir):
    return evaluation.accuracy_and_recall(source_table(spark, sf_dir, "labels"), "quality", "toxic").select(*r6("accuracy", "recall"))


@query(
    sql.cte(sql.view("kernels"), ("e", "SELECT CAST(min(TotalViews) AS DOUBLE) AS a, CAST(max(TotalViews) AS DOUBLE) AS b FROM kernels"))
    + "SELECT CAST(least(floor((TotalViews - a) / (b - a) * 10), 9) AS BIGINT) AS bin, round(a + least(floor((TotalViews - a) / (b - a) * 10), 9) * (b - a) / 10, 6) "
    "AS bin_start, count(*) AS n FROM kernels, e GROUP BY 1, 2"
)
def histogram(spark, sf_dir):
    return evaluation.histogram(view(spark, sf_dir, "kernels"), "TotalViews").select(*longs("bin"), *r6("bin_start"), "n")


@query(
    sql.cte(sql.view("comments"))
    + "SELECT c AS \"column\", count(*) AS \"rows\", count(*) FILTER (WHERE m) AS nulls FROM (SELECT unnest(['Text', 'DisplayName_commentuser', 'CommentVote']) AS c, "
    "unnest([Text IS NULL, DisplayName_commentuser IS NULL, CommentVote IS NULL]) AS m FROM comments) GROUP BY c"
)
def table_profile(spark, sf_dir):
    comments = view(spark, sf_dir, "comments").select("Text", "DisplayName_commentuser", "CommentVote")
    return evaluation.profile(comments).select("column", "rows", "nulls")


@query(
    "SELECT doc_id AS KernelId, 'quality' AS Metric, CAST(quality AS BIGINT) AS Score FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels"
)
def metrics_long(spark, sf_dir):
    labels = source_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("KernelId"), *longs("quality", "toxic"))
    return evaluation.metrics_to_long(labels, ["KernelId"], ["quality", "toxic"])
