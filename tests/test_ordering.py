import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from nbgauge.operators import ordering


@pytest.fixture(scope="module")
def table(spark):
    """A third of the rows share one score; some have none."""
    draw = random.Random(5)
    rows = [(i, None if i % 50 == 0 else 1.0 if i % 3 == 0 else draw.random() * 2) for i in range(1000)]
    return spark.createDataFrame(rows, "KernelId bigint, score double").repartition(5)


def in_order(table):
    return sorted((tuple(r) for r in table.collect()), key=lambda r: (r[1] is None, r[1] or 0, r[0]))


def test_global_rank(table):
    ranked = ordering.with_global_rank(table, "score", "KernelId").orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 1001))
    assert [(r.KernelId, r.score) for r in ranked] == in_order(table)


def test_lowest(table):
    expected = {r[0] for r in in_order(table)[:400]}
    assert {r.KernelId for r in ordering.lowest(table, 400, "score", "KernelId").collect()} == expected
    assert ordering.lowest(table, 5000, "score").count() == 1000
    assert ordering.lowest(table, 0, "score").count() == 0


def test_cuts_through_equal_rows(spark):
    """Rows equal in all columns: each part gets exactly its number of them."""
    rows = spark.createDataFrame([(1, 2.0)] * 4 + [(2, None), (3, None)], "KernelId bigint, score double").repartition(3)
    assert [tuple(r) for r in ordering.lowest(rows, 2, "score", "KernelId").collect()] == [(1, 2.0)] * 2
    halves = ordering.split_at_rank(rows, "score")
    assert sorted(map(tuple, halves.collect()), key=repr) == sorted([(1, 2.0, 0)] * 3 + [(1, 2.0, 1), (2, None, 1), (3, None, 1)], key=repr)
    split = ordering.random_split(rows, 0.3)
    assert {r.split: r.n for r in ordering.class_counts(split, "split").collect()} == {"test": 2, "train": 4}
    # Several cuts through one group, and a cut through rows without a score.
    cuts = ordering.RankCuts(rows, "score")
    runs = sorted(r["_run"] for r in cuts.cut(1, 1, 3, 5).collect())
    assert runs == [0, 2, 2, 3, 3, 4]
    twice = ordering.select_extremes(spark.range(40).selectExpr("id % 2 AS KernelId", "1.0D AS score"), "score", 0.5, 0.5)
    assert {r.label: r.n for r in ordering.class_counts(twice, "label").collect()} == {0: 10, 1: 10}


def test_ties_differ_by_hash_only(spark):
    """Rows with one key but other values: the same ones are picked however they are stored; maps and NaN do not disturb."""
    rows = spark.range(30).selectExpr("1 AS KernelId", "double('NaN') AS score", "id AS x", "map('a', id) AS m")
    one = {r.x for r in ordering.lowest(rows.repartition(2), 7, "score", "KernelId").collect()}
    two = {r.x for r in ordering.lowest(rows.repartition(5), 7, "score", "KernelId").collect()}
    assert one == two and len(one) == 7


def test_extremes(table):
    rows = in_order(table)
    found = ordering.select_extremes(table, "score").collect()
    low, high = ordering.extreme_sizes(1000)
    assert (low, high) == (175, int(0.25 * (1 - 0.7) * 1000))
    assert {r.KernelId for r in found if r.label == 0} == {r[0] for r in rows[:low]}
    assert {r.KernelId for r in found if r.label == 1} == {r[0] for r in rows[-high:]}
    assert ordering.extreme_sizes(100) == (17, 7)


def test_split_at_rank_and_ends(table):
    rows = in_order(table)
    halves = ordering.split_at_rank(table, "score")
    assert {r.KernelId for r in halves.where("label = 0").collect()} == {r[0] for r in rows[:500]}
    ends = ordering.head_and_tail(table, 3)
    assert sorted(r.KernelId for r in ends.collect()) == sorted(r[0] for r in rows[:3] + rows[-3:])
    same = ordering.select_symmetric(table, 0.1, "score")
    assert [r.n for r in ordering.class_counts(same, "label").collect()] == [100, 100]


def test_equal_ids_are_cut_exactly(spark):
    """One id holds a third of the rows."""
    rows = spark.range(300).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("KernelId"), F.col("id").alias("x"), F.lit(1.0).alias("score"))
    assert ordering.split_at_rank(rows, "score").where("label = 0").count() == 150


def test_balanced_head(spark):
    rows = spark.createDataFrame([(i, int(i > 4)) for i in range(20)], "KernelId int, expert_score int")
    found = ordering.balanced_head(rows)
    assert sorted(r.KernelId for r in found.collect()) == list(range(10))


def test_splits(table):
    small = table.where("KernelId < 24")
    split = ordering.random_split(small)
    assert {r.split: r.n for r in ordering.class_counts(split, "split").collect()} == {"test": 3, "train": 21}
    again = ordering.random_split(small.repartition(3))
    assert sorted(map(tuple, split.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)
    three = {r.split: r.n for r in ordering.class_counts(ordering.three_way_split(table), "split").collect()}
    assert three == {"eval": 130, "test": 218, "train": 652}


def test_samples(table):
    sample = ordering.sample_rows(table, 100)
    assert sample.count() == 100 and sample.select("KernelId").distinct().count() == 100
    assert ordering.first_rows(table, table.limit(7)).count() == 7


def test_empty_table(spark):
    empty = spark.createDataFrame([], "KernelId int, score double")
    assert ordering.select_extremes(empty, "score").count() == 0
    assert ordering.with_global_rank(empty, "score").count() == 0


KEYS = {
    "double": [0.0, -0.0, 1.5, -1.5, 1e308, -1e308, 5e-324, float("inf"), float("-inf"), float("nan"), None, 2.0, 2.0 + 2**-51],
    "string": ["", "a", "a\x00", "a\x00\x00", "ab", "abcdef", "abcdefg", "abcdef\x00", "abcdefghijklm", "é", "zz", "日本", "😀", None, "abcdefghijkl"],
    "bigint": [0, -1, 1, 2**53, 2**53 + 1, -(2**53) - 1, 2**63 - 1, -(2**63), 2**32, 2**32 - 1, None],
    "decimal(38,3)": [Decimal("0.001"), Decimal("-0.001"), Decimal(10**34), Decimal(10**34) + Decimal("0.001"), Decimal(10**34) - Decimal("0.001"), None],
    "date": [date(1969, 12, 31), date(1970, 1, 1), date(2024, 2, 29), None],
    "timestamp": [datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(2024, 2, 29, 1, 2, 3, 4), datetime(2024, 2, 29, 1, 2, 3, 5), None],
    "boolean": [True, False, None],
}


@pytest.mark.parametrize("kind", KEYS)
def test_keys_found_by_counting(spark, monkeypatch, kind):
    """Every rank, narrowed down to one key, as a sort gives it."""
    rng = random.Random(kind)
    rows = [(rng.choice(KEYS[kind]), rng.choice(KEYS["bigint"][:4]), i) for i in range(120)]
    df = spark.createDataFrame(rows, f"k {kind}, id bigint, n int").repartition(3)
    cuts = ordering.RankCuts(df, "k", "id")
    expected = [tuple(r) for r in cuts._keyed.orderBy(*[F.col(c).asc_nulls_last() for c in cuts._keyed.columns]).collect()]
    monkeypatch.setattr(ordering, "FEW_KEYS", 0)
    ranks = [1, 2, 17, 60, 61, 119, 120]
    found = ordering.keys_at_ranks(cuts._keyed, cuts.size, ranks)
    assert {r: repr(k).replace("-0.0", "0.0") for r, k in found.items()} == {r: repr(expected[r - 1]).replace("-0.0", "0.0") for r in ranks}


def test_cuts_move_and_sort_no_rows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "FEW_KEYS", 50)
    rows = spark.range(5000).select(F.col("id").alias("KernelId"), (F.col("id") * 7919 % 1009 / 10).alias("score"))
    halves = ordering.RankCuts(rows, "score", "KernelId").cut(1000, 3500)
    plan = halves._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    order = sorted(rows.collect(), key=lambda r: (r.score, r.KernelId))
    for run, part in enumerate((order[:1000], order[1000:3500], order[3500:])):
        assert {r.KernelId for r in halves.where(F.col("_run") == run).collect()} == {r.KernelId for r in part}


def test_kinds_without_an_order(spark):
    with pytest.raises(TypeError):
        ordering.key_words(F.col("x"), ArrayType(IntegerType()), 0)
