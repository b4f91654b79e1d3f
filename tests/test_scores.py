import math

import pandas as pd
import pytest

from nbgauge import schemas
from nbgauge.operators import cleaning
from nbgauge.operators.scores import augment_with_kernels, comment_scores, drop_outliers, scale_scores, with_votes_per_view
from nbgauge.plans.quality import kernel_facts


def comment(kernel, views, votes, vote, score, **more):
    row = dict(
        KernelId=kernel, CommentId=1, Text="t", Message="m", DisplayName_kerneluser="a", DisplayName_commentuser="b",
        AuthorUserId=1, UserName="u", CurrentUrlSlug="s", TotalViews=views, TotalVotes=votes,
        PerformanceTier_kerneluser=2, CommentVote=vote, bert_score=score,
    )
    return {**row, **more}


def comments(spark, rows):
    names = [c.split(" ")[0] for c in schemas.COMMENTS.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schemas.COMMENTS)


def test_comment_scores(spark):
    rows = comments(spark, [comment(1, 100, 3, 2, 1.0), comment(1, 100, 3, 1, None), comment(2, 0, 1, 0, 1.0), comment(None, 4, 1, 0, 1.0)])
    found = {r.KernelId: r for r in comment_scores(rows).collect()}
    assert set(found) == {1, 2}
    assert (found[1].CommentVote, found[1].bert_score, found[1].pure_topic_score) == (3, 1.0, 4.0)
    assert found[1].topic_score == pytest.approx(1.4) and math.isinf(found[2].topic_score)


def test_augment_and_scale(spark):
    scored = comment_scores(comments(spark, [comment(1, 100, 0, 0, 0.0), comment(2, 400, 5, 0, 20.0)]))
    kernels = spark.createDataFrame([(1, 7, 0, 400, "k1"), (3, 7, 10, 100, "k3"), (4, 7, 5, 0, "k4"), (5, 8, 600, 100, "k5")], schemas.KERNELS)
    users = spark.createDataFrame([(7, "ann", 4), (8, "bo", 1)], schemas.USERS)
    features = spark.createDataFrame([(k,) for k in (1, 1, 3, 4, 5)], "kernel_id bigint")
    facts = kernel_facts(features, kernels, users)
    assert facts.count() == 4
    quality = {r.KernelId: r for r in augment_with_kernels(scored, facts).collect()}
    assert (quality[1].TotalViews, quality[1].UserName, quality[1].PerformanceTier_kerneluser) == (400, "ann", 4)
    assert (quality[2].TotalViews, quality[2].UserName) == (400, "u")
    assert quality[1].topic_score == pytest.approx(1.0)  # from the comments, not the fallback
    assert quality[3].topic_score == pytest.approx(1.0) and math.isinf(quality[4].topic_score)
    kept = drop_outliers(augment_with_kernels(scored, facts))
    assert {r.KernelId for r in kept.collect()} == {1, 2, 3}
    scaled = {r.KernelId: r for r in scale_scores(kept).collect()}
    assert [scaled[k].vote_scaled for k in (1, 2, 3)] == [0.0, 0.5, 1.0]
    assert all(0 <= r.score_scaled <= 1 and r.combined_score == r.score_scaled + r.vote_scaled for r in scaled.values())


def test_equal_scores_have_no_scale(spark):
    rows = spark.createDataFrame([(1, 1.0, 5), (2, 1.0, 5)], "KernelId int, topic_score double, TotalVotes int")
    assert all(r.score_scaled is None for r in scale_scores(rows).collect())


def test_votes_per_view(spark):
    rows = spark.createDataFrame([(1, 4), (1, 0)], "TotalVotes int, TotalViews int")
    assert [r.score for r in with_votes_per_view(rows).collect()] == [0.5, None]


def test_comment_filters(spark):
    rows = comments(
        spark,
        [
            comment(1, 1, 1, 1, 1.0), comment(2, 1, 1, 1, 1.0, DisplayName_commentuser="a"),
            comment(3, 1, 1, 1, 1.0, DisplayName_commentuser=None), comment(4, 1, 1, 1, 1.0, Text=None),
            comment(5, 1, 1, 1, 1.0, Text="x" * 257), comment(6, 1, 1, 1, 1.0, Text="é" * 256),
            comment(7, 1, 1, 1, 1.0, Message="see <a href"), comment(8, 1, 1, 1, 1.0, Message=None),
        ],
    )
    assert {r.KernelId for r in cleaning.clean_comments(rows).collect()} == {1, 3, 6, 8}


def test_language(spark):
    rows = spark.createDataFrame([("en", 0.9), ("fr", 0.9), ("fr", 0.7), (None, 0.9)], "lang string, lang_conf double")
    assert cleaning.in_language(rows).count() == 3
    texts = spark.createDataFrame([("a\nb",)], "Text string")
    detect = lambda t: pd.DataFrame({"l": t, "c": 0.5})
    assert tuple(cleaning.with_language(texts, detect).first()) == ("a\nb", "a b", 0.5)


def test_topic_label(spark):
    sheet = spark.createDataFrame([(1, "a", 1, 0), (2, "b", None, 1), (3, "c", 0, None)], "Id int, Text string, advertise int, topic int")
    assert {r.Id: r.label for r in cleaning.topic_label(sheet, "topic", "advertise").collect()} == {2: 1, 3: 0}


def test_feature_cleaning(spark):
    rows = spark.createDataFrame([("1", "5", "2"), ("1", "5", "2"), ("2", "x", "2"), ("3", "4", None)], "kernel_id string, LOC string, MC string")
    assert [tuple(r) for r in cleaning.clean_features(rows).collect()] == [("1", 5.0, 2.0)]
    broken = spark.createDataFrame([("Unnamed: 27", "1"), ("1", "0.0.1"), (None, "1")], "MC string, H2 string")
    assert cleaning.drop_broken_rows(broken).count() == 1
    features = spark.createDataFrame([(1, 2.0, 3, "ML")], "KernelId int, ALLC double, PT int, TYPE string")
    assert cleaning.features_only(features).columns == ["ALLCL", "PT"]
    assert cleaning.features_only(features, include_pt=False).columns == ["ALLCL"]
