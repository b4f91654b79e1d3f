"""Boosted trees, forests and attributions against plain versions that try every split on raw values."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nbgauge.operators import attribution, boosting, forest, trees
from nbgauge.operators.trees import TreeModel

NAMES = ["a", "b", "c"]


def table(n=500, seed=3, missing=0.1, levels=40):
    """Rows (a, b, c, label) with a label that follows a and b, some values missing."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, levels, size=(n, 3)).astype(float)
    label = ((x[:, 0] > levels / 2) ^ (x[:, 1] > levels / 3) ^ (rng.random(n) < 0.1)).astype(int)
    x[rng.random((n, 3)) < missing] = np.nan
    return x, label


def frame(spark, x, label, parts=3):
    rows = [(*[None if np.isnan(v) else float(v) for v in r], int(y)) for r, y in zip(x, label)]
    return spark.createDataFrame(rows, "a double, b double, c double, label int").repartition(parts)


def paths(tree):
    return {row[1]: row for row in tree.rows(0, [np.arange(300.0)] * 3)}


# -- bins -----------------------------------------------------------------------


def test_walls_of_few_and_many_values(spark):
    df = spark.range(20_000).select(
        F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.when(F.col("id") < 0, 1.0).alias("c"),
        F.when(F.col("id") < 10_000, 9.0).otherwise(1.0).alias("w"), F.when(F.col("id") % 3 == 0, float("nan")).otherwise(2.0).alias("d"),
    )
    many, few, none, one = trees.walls_of(df, ["a", "b", "c", "d"], bins=50)
    assert len(many) == 49 and np.abs(np.diff(many) - 400).max() <= 20
    assert few.tolist() == [0, 1, 2, 3, 4, 5] and none.tolist() == [] and one.tolist() == []
    heavy = trees.walls_of(df, ["a"], weight="w", bins=50)[0]
    assert 43 <= (heavy < 10_000).sum() <= 46
    assert trees.bin_numbers(np.array([np.nan, -1, 0, 0.5, 5, 5.5, np.inf]), few).tolist() == [0, 1, 1, 2, 6, 7, 7]


# -- plain learners -------------------------------------------------------------

UNIT = float(1 << 30)


def slopes(margin, label):
    p = 1 / (1 + np.exp(-margin))
    return np.rint((label - p) * UNIT) / UNIT, np.rint(p * (1 - p) * UNIT) / UNIT


def plain_symmetric(x, label, block, rounds, rate, depth, ridge):
    low = np.where(np.isnan(x), -1.0, x)
    ordered, final = np.zeros(len(x)), np.zeros(len(x))
    structures = []
    for _ in range(rounds):
        g, h = slopes(ordered, label)
        node, walls = np.zeros(len(x), int), []
        score = lambda node: sum(g[node == k].sum() ** 2 / ((node == k).sum() + ridge) for k in np.unique(node))
        now = score(node)
        for _ in range(depth):
            tried = [(score(2 * node + (low[:, f] > v)), -f, -v) for f in range(3) for v in np.unique(low[:, f])[:-1]]
            best = max(tried)
            if not best[0] > now * (1 + 1e-9) + 1e-12:
                break
            now = best[0]
            walls.append((-best[1], -best[2]))
            node = 2 * node + (low[:, walls[-1][0]] > walls[-1][1])
        structures.append(walls)
        for k in np.unique(node):
            here = node == k
            final[here] += rate * g[here].sum() / (h[here].sum() + ridge)
        step = np.zeros(len(x))
        for i in range(len(x)):
            before = (node == node[i]) & (block < block[i])
            step[i] = rate * g[before].sum() / (h[before].sum() + ridge)
        ordered += step
    return structures, final


def plain_second_order(x, label, rounds, rate, depth, ridge, least_hessian):
    margin = np.zeros(len(x))
    score = lambda g, h, rows: g[rows].sum() ** 2 / (h[rows].sum() + ridge)

    def grow(g, h, rows, level, out):
        best = (1e-12, None)
        if level < depth:
            for f in range(3):
                v = x[rows, f]
                gone = np.isnan(v)
                for wall in np.unique(v[~gone]):
                    for missing_left in (True, False):
                        left = np.where(gone, missing_left, v <= wall)
                        one, two = rows[left], rows[~left]
                        if not len(one) or not len(two) or min(h[one].sum(), h[two].sum()) < least_hessian:
                            continue
                        gain = (score(g, h, one) + score(g, h, two) - score(g, h, rows)) / 2
                        if gain > best[0] * (1 + 1e-12):
                            best = (gain, (one, two))
        if best[1] is None:
            out[rows] = rate * g[rows].sum() / (h[rows].sum() + ridge)
            return
        grow(g, h, best[1][0], level + 1, out)
        grow(g, h, best[1][1], level + 1, out)

    for _ in range(rounds):
        g, h = slopes(margin, label)
        step = np.zeros(len(x))
        grow(g, h, np.arange(len(x)), 0, step)
        margin += step
    return margin


@pytest.mark.parametrize("several", [False, True])
def test_symmetric_trees_as_plain(spark, monkeypatch, several):
    """Twelve rounds, so margins are also written anew once; one partition, and added histograms."""
    monkeypatch.setattr(boosting, "PARTITION_ROWS", 100 if several else 100_000)
    x, label = table(300, levels=12)
    df = frame(spark, x, label)
    walls = trees.walls_of(df, NAMES)
    rows = boosting.training_rows(df, NAMES, walls, "label", 0)
    assert rows.single != several
    block = {}
    for r in rows.df.collect():
        block.setdefault((bytes(r.bins), r._label), r._block)
    bins = np.stack([trees.bin_numbers(x[:, f], walls[f]) for f in range(3)], axis=1)
    own = np.array([block[b.tobytes(), float(y)] for b, y in zip(bins, label)])
    model = boosting.SymmetricBoosting(rounds=12, rate=0.3, depth=3).fit(df, NAMES)
    structures, margin = plain_symmetric(x, label, own, 12, 0.3, 3, 3.0)
    assert len(set(own.tolist())) > 3
    for tree, plain in zip(model.trees(), structures):
        got, node = [], 0
        while tree.feature[node] >= 0:
            f, b = int(tree.feature[node]), int(tree.bin[node])
            got.append((f, float(walls[f][b - 1]) if b else -1.0))
            node = int(tree.left[node])
        assert got == plain
    scored = {(r.a, r.b, r.c): r.margin for r in model.with_margin(df).collect()}
    for values, m in zip(x, margin):
        assert scored[tuple(None if np.isnan(v) else v for v in values)] == pytest.approx(m, abs=1e-9)


@pytest.mark.parametrize("several", [False, True])
def test_second_order_trees_as_plain(spark, monkeypatch, several):
    monkeypatch.setattr(boosting, "PARTITION_ROWS", 100 if several else 100_000)
    x, label = table(500, levels=12)
    df = frame(spark, x, label)
    model = boosting.SecondOrderBoosting(rounds=11, depth=3).fit(df, NAMES)
    margin = plain_second_order(x, label, 11, 0.3, 3, 1.0, 1.0)
    scored = {(r.a, r.b, r.c): r.margin for r in model.with_margin(df).collect()}
    for values, m in zip(x, margin):
        assert scored[tuple(None if np.isnan(v) else v for v in values)] == pytest.approx(m, abs=1e-9)
    predicted = model.predict(df).collect()
    assert np.mean([r.prediction == r.label for r in predicted]) > 0.8
    assert all(0 < r.score < 1 and r.prediction == (r.score > 0.5) for r in predicted)


def test_missing_values_find_their_side(spark):
    """Missing values of the one class go to that class's side, without being filled."""
    rows = [(None, 1)] * 30 + [(float(i), 0) for i in range(30)] + [(100.0 + i, 1) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, label int")
    model = boosting.SecondOrderBoosting(rounds=1, depth=1).fit(df, ["a"])
    tree = model.trees()[0]
    assert not tree.missing_left[0] and model.nodes.where("path = ''").first().wall == 29.0
    assert all(r.prediction == r.label for r in model.predict(df).collect())
    # A label told by missing values alone.
    rows = [(None, 1)] * 30 + [(float(i), 0) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, label int")
    for learner in (boosting.SymmetricBoosting(rounds=2), forest.DecisionTree()):
        assert all(r.prediction == r.label for r in learner.fit(df, ["a"]).predict(df).collect())


def test_trees_of_odd_tables(spark):
    same = spark.createDataFrame([(1.0, 1), (1.0, 0), (1.0, 1)], "a double, label int")
    for learner in (boosting.SymmetricBoosting(rounds=2), boosting.SecondOrderBoosting(rounds=2), forest.DecisionTree(), forest.Forest(trees=3)):
        model = learner.fit(same, ["a"])
        assert all(len(t.feature) == 1 for t in model.trees())
        assert {r.prediction for r in model.predict(same).collect()} == {1}
    labelled = same.union(spark.createDataFrame([(9.0, None)], "a double, label int"))
    assert forest.DecisionTree().fit(labelled, ["a"]).trees()[0].cover[0] == 3


# -- trees and forests ----------------------------------------------------------


def plain_cart(x, label, weight, rows, shape, level=0, path="", out=None):
    """path: (feature, wall, value, rows) of a tree on all features; missing values count as lowest."""
    out = {} if out is None else out
    n, ones = weight[rows].sum(), weight[rows][label[rows] == 1].sum()
    impure = lambda r: weight[r].sum() - (weight[r][label[r] == 1].sum() ** 2 + weight[r][label[r] == 0].sum() ** 2) / max(1, weight[r].sum())
    best = None
    if 0 < ones < n and n >= shape.least_split and n >= 2 * shape.least_leaf and (shape.depth is None or level < shape.depth):
        for f in range(x.shape[1]):
            for wall in np.unique(x[rows, f])[:-1]:
                left, right = rows[x[rows, f] <= wall], rows[x[rows, f] > wall]
                if min(weight[left].sum(), weight[right].sum()) >= shape.least_leaf:
                    gain = impure(rows) - impure(left) - impure(right)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, f, wall, left, right)
    out[path] = (best[1] if best else -1, best[2] if best else None, ones / n, n)
    if best:
        plain_cart(x, label, weight, best[3], shape, level + 1, path + "L", out)
        plain_cart(x, label, weight, best[4], shape, level + 1, path + "R", out)
    return out


@pytest.mark.parametrize("in_task_rows", [100_000, 60, 1])
@pytest.mark.parametrize("depth,least_leaf,least_split", [(None, 1, 2), (4, 3, 2), (None, 1, 40)])
def test_decision_tree_as_plain(spark, in_task_rows, depth, least_leaf, least_split):
    """Finished by one task, by levels of Spark, or both."""
    if in_task_rows == 1 and depth is None and least_split == 2:
        pytest.skip("one level after the other, tested with a depth")
    x, label = table(240, missing=0.0, levels=9)
    df = frame(spark, x, label)
    model = forest.DecisionTree(depth, least_leaf, least_split, in_task_rows=in_task_rows).fit(df, NAMES)
    got = {r.path: (r.feature, r.wall, r.value, r.cover) for r in model.nodes.collect()}
    want = plain_cart(x, label, np.ones(len(x), int), np.arange(len(x)), forest.Shape(depth, least_leaf, least_split))
    assert got == {p: (f, w, pytest.approx(v), n) for p, (f, w, v, n) in want.items()}


def test_tree_deeper_than_thirty_levels(spark):
    """A label that changes with every value needs a deep chain of walls if leaves are cut off one by one."""
    rows = [(float(2**i if i < 60 else i), i % 2) for i in range(60) for _ in range(1)]
    df = spark.createDataFrame(rows, "a double, label int")
    model = forest.DecisionTree().fit(df, ["a"])
    assert model.trees()[0].depth >= 6 and all(r.prediction == r.label for r in model.predict(df).collect())
    chain = [f"{'R' * i}" for i in range(200)] + [f"{'R' * i}L" for i in range(199)]
    inner = [i < 199 for i in range(200)] + [False] * 199
    nodes = [(0, p, 0 if k else -1, 0, float(len(p)) if k else None, True, float(len(p)), 1.0, 1.0) for p, k in zip(chain, inner)]
    walls = np.arange(199.0)
    nodes = [(t, p, f, len(p) + 1 if f == 0 else 0, w, m, v, c, g) for t, p, f, _, w, m, v, c, g in nodes]
    deep = TreeModel(["a"], [walls], "margin", spark.createDataFrame(nodes, trees.NODES), len(nodes), {"trees": 1})
    assert deep.trees()[0].depth == 199
    asked = spark.createDataFrame([(float(v),) for v in range(200)], "a double")
    assert {r.a: r.margin for r in deep.with_margin(asked).collect()} == {float(v): float(min(v + 1, 199)) for v in range(200)}


def test_forest_grows_alike_however_it_is_grown(spark, monkeypatch):
    x, label = table(300)
    shape = forest.Shape(6, 2, 5)
    df = frame(spark, x, label)
    found = [
        sorted(map(repr, forest.Forest(4, shape, in_task_rows=rows).fit(d, NAMES).nodes.drop("gain").collect()))
        for rows, d in ((100_000, df), (40, df), (100_000, df.repartition(7)))
    ]
    assert found[0] == found[1] == found[2]
    # Rows that are drawn: about as many as there are, other ones for each tree.
    weights = [forest.bootstrap_weights(np.arange(20_000), t, 1) for t in range(2)]
    assert all(abs(w.mean() - 1) < 0.03 and abs((w == 0).mean() - math.exp(-1)) < 0.02 for w in weights) and (weights[0] != weights[1]).any()
    asked = [tuple(forest.asked_features(0, forest.path_number(p), 30, 5, 1)) for p in ("", "L", "R", "LR", "RL")]
    assert len(set(asked)) == 5 and all(len(set(a)) == 5 for a in asked)


def test_joined_scoring_as_shipped(spark, monkeypatch):
    x, label = table(200)
    df = frame(spark, x, label).withColumn("id", F.monotonically_increasing_id())
    model = forest.Forest(5, forest.Shape(5)).fit(df, NAMES)
    shipped = {r.id: r.score for r in model.predict(df).collect()}
    monkeypatch.setattr(trees, "SHIPPED_NODES", 3)
    joined = {r.id: r.score for r in model.predict(df).collect()}
    assert joined == {k: pytest.approx(v) for k, v in shipped.items()} and len(joined) == 200
    with pytest.raises(ValueError):
        model.trees()


def test_search_takes_the_shape_that_does_best(spark):
    x, label = table(400, missing=0.0)
    df = frame(spark, x, label)
    search = forest.ForestSearch(candidates=4, folds=3, trees=8, together=5)
    model = search.fit(df, NAMES)
    means = model.info["accuracy"]
    assert len(means) == 4 and forest.candidates(4)[int(np.argmax(means))].__dict__ == model.info["shape"]
    # Accuracy of one forest on a fold it did not see, from the raw rows.
    rows = forest.numbered(df, NAMES, model.walls, "label")
    shape = forest.candidates(4)[0]
    plan = forest.Plan((shape,) * 8, (1,) * 8, 3, 3, 42)
    nodes = forest.grow(rows, plan)
    got = forest.fold_accuracy(rows, nodes, plan, 8).collect()[0].accuracy
    grown = TreeModel([], [], "share", nodes.select("*", F.lit(True).alias("missing_left")), 1).trees()
    hits = []
    for r in rows.collect():
        if forest.fold_of(np.array([r.row]), 3, 42)[0] == 1:
            bins = np.frombuffer(bytes(r.bins), np.uint8)[None]
            hits.append((np.mean([t.value[t.leaves(bins)][0] for t in grown]) > 0.5) == (r.label == 1))
    assert got == pytest.approx(np.mean(hits)) and 90 < len(hits) < 180


def test_saved_model_is_the_same(spark, tmp_path):
    x, label = table(150)
    df = frame(spark, x, label)
    for learner in (boosting.SecondOrderBoosting(rounds=3), forest.Forest(3)):
        model = learner.fit(df, NAMES)
        model.save(str(tmp_path / "model"))
        again = TreeModel.load(spark, str(tmp_path / "model"))
        assert sorted(map(repr, again.predict(df).collect())) == sorted(map(repr, model.predict(df).collect()))
        assert again.info == model.info and sum(again.importance().values()) == pytest.approx(1.0)


# -- attributions ---------------------------------------------------------------


def expected(tree, bins, known, node=0):
    """Value of a row if only the features in ``known`` are known."""
    f = int(tree.feature[node])
    if f < 0:
        return tree.value[node]
    if not tree.cover[node]:
        return 0.0
    left, right = int(tree.left[node]), int(tree.right[node])
    if f in known:
        goes_left = tree.missing_left[node] if bins[f] == 0 else bins[f] <= tree.bin[node]
        return expected(tree, bins, known, left if goes_left else right)
    return (tree.cover[left] * expected(tree, bins, known, left) + tree.cover[right] * expected(tree, bins, known, right)) / tree.cover[node]


def test_attributions_as_the_sum_over_all_subsets(spark):
    """Eight features, every subset of them."""
    rng = np.random.default_rng(12)
    names = list("abcdefgh")
    x = rng.integers(0, 6, size=(400, 8)).astype(float)
    x[rng.random(x.shape) < 0.05] = np.nan
    label = (np.nan_to_num(x[:, 0]) + np.nan_to_num(x[:, 1]) * (np.nan_to_num(x[:, 2]) > 2) - np.nan_to_num(x[:, 3]) > 2).astype(int)
    rows = [(*[None if np.isnan(v) else float(v) for v in r], int(y)) for r, y in zip(x, label)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", label int")
    for learner in (boosting.SecondOrderBoosting(rounds=4, depth=5), boosting.SymmetricBoosting(rounds=3, rate=0.5), forest.Forest(3, forest.Shape(None, features=4))):
        model = learner.fit(df, names)
        grown, divide = model.trees(), model.n_trees if model.link == "share" else 1
        found = attribution.attributions(model, model.with_margin(df)).limit(12).collect()
        for r in found:
            assert r.base + sum(r.attributions) == pytest.approx(r.margin, abs=1e-9)
        for r in found[:4]:
            bins = [int(trees.bin_numbers(np.array([np.nan if r[c] is None else r[c]]), w)[0]) for c, w in zip(names, model.walls)]
            value = {}
            for size in range(9):
                for known in itertools.combinations(range(8), size):
                    value[known] = sum(expected(t, bins, known) for t in grown) / divide
            assert r.base == pytest.approx(value[()], abs=1e-9)
            for i in range(8):
                total = 0.0
                for known in value:
                    if i not in known:
                        chance = math.factorial(len(known)) * math.factorial(7 - len(known)) / math.factorial(8)
                        total += chance * (value[tuple(sorted((*known, i)))] - value[known])
                assert r.attributions[i] == pytest.approx(total, abs=1e-9)


def test_mean_attributions_name_what_matters(spark):
    draw = random.Random(5)
    rows = [(float(i % 50), draw.random(), None, int(i % 50 > 25)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double, label int")
    model = boosting.SecondOrderBoosting(rounds=5, depth=2).fit(df, NAMES)
    found = {r.feature: r.mean_size for r in attribution.mean_attributions(model, df).collect()}
    assert found["a"] > 0.5 and found["c"] == 0 and found["b"] < 0.05 * found["a"]


# -- many equal rows --------------------------------------------------------------


def test_equal_rows_are_trained_on_once(spark):
    df = spark.range(3000).select(*[(F.col("id") % 3).cast("double").alias(c) for c in NAMES], (F.col("id") % 3 == 1).cast("int").alias("label"))
    rows = boosting.training_rows(df, NAMES, trees.walls_of(df, NAMES), "label", 0).df.collect()
    assert len(rows) == 3 and sum(r._copies for r in rows) == 3000


def test_copies_are_added_in_whole_numbers():
    weight, copies = np.array([2.0**30 - 1, -(2.0**30) + 3, 5.0]), np.array([(1 << 31) + 1, (1 << 30) + 1, 3])
    assert boosting._added(np.array([0, 1, 0]), weight, copies, 2).tolist() == [((1 << 30) - 1) * ((1 << 31) + 1) + 15, (3 - (1 << 30)) * ((1 << 30) + 1)]


def test_equal_rows_are_dealt_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(forest, "DEALT_ROWS", 100)
    df = spark.range(2000).select(*[F.lit(1.0).alias(c) for c in NAMES], (F.col("id") < 1000).cast("int").alias("label"))
    rows = forest.numbered(df, NAMES, trees.walls_of(df, NAMES), "label")
    sizes = [len(p) for p in rows.rdd.glom().collect()]
    assert sum(sizes) == rows.select("row").distinct().count() == 2000 and max(sizes) <= 600
    plan = forest.Plan((forest.Shape(),) * 5, (-1,) * 5, 1, 3, 42)
    dealt = forest._dealt(rows, plan).groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")).collect()
    number = np.array([r.row for r in rows.collect()])
    assert {r.tree: r.weight for r in dealt} == {tree: forest.bootstrap_weights(number, tree, 42).sum() for tree in range(5)}
    assert all(r.n <= 60 for r in dealt)


def test_rows_of_a_kind():
    for width in (1, 3, 8, 9, 30):
        table = np.random.default_rng(width).integers(0, 2, size=(200, width)).astype(np.uint8)
        first, kind = trees.distinct_rows(table)
        assert (table[first][kind] == table).all() and len(first) == len({r.tobytes() for r in table})


@pytest.mark.parametrize("learner", [boosting.SymmetricBoosting(rounds=12, rate=0.1, depth=3), boosting.SecondOrderBoosting(rounds=12, depth=3)])
def test_one_task_grows_all_trees_without_a_job_per_level(spark, monkeypatch, learner):
    df = frame(spark, *table(400, missing=0))
    monkeypatch.setattr(boosting, "PARTITION_ROWS", 100)
    by_level = learner.fit(df, NAMES).nodes.orderBy("tree", "path").collect()
    monkeypatch.setattr(boosting, "PARTITION_ROWS", 100_000)
    passes = []
    for name in ("sums", "leaf_sums", "advanced"):
        monkeypatch.setattr(boosting.Rows, name, lambda self, *a, name=name: passes.append(name))
    assert learner.fit(df, NAMES).nodes.orderBy("tree", "path").collect() == by_level and not passes


def test_walls_by_order_are_those_by_table():
    draw = np.random.default_rng(4)
    for least_leaf, heaviest in ((1, 1), (3, 9)):
        node, bins = draw.integers(0, 40, 3000), draw.integers(0, 256, 3000) // draw.integers(1, 60, 3000)
        node[:40] = np.arange(40)
        label, weight = draw.integers(0, 2, 3000), draw.integers(1, heaviest + 1, 3000)
        ones = np.bincount(node, weights=weight * label)
        total = np.bincount(node, weights=weight) - ones, ones
        by_table = forest._walls_by_table(node * 256 + bins, label, weight, total, least_leaf)
        by_order = forest._walls_by_order(node * 256 + bins, label, weight, total, least_leaf)
        found = np.isfinite(by_table[0])
        assert (by_table[0] == by_order[0]).all() and (by_table[1] == by_order[1])[found].all() and found.any()


def test_what_is_left_of_a_node_is_its_larger_part():
    """Histograms of a level, of which half of the nodes are counted, are those of a table that begins there."""
    draw = np.random.default_rng(5)
    columns = draw.integers(0, 9, (2000, 3)).astype(np.uint8), draw.integers(0, 2, 2000), draw.integers(0, 8, 2000), draw.integers(1, 4, 2000), draw.normal(size=2000)
    levels = [np.zeros(2000, int)]
    for f in range(3):
        levels.append(2 * levels[-1] + (columns[0][:, f] > 2))
    # Some rows end in a node that is not looked at.
    levels[3] = np.where(levels[2] == 1, 6, np.minimum(levels[3], 6))

    def seen(held, node, nodes, open_nodes, weight):
        sums = []
        held.sums([], lambda bins, before: node, lambda f, total: (sums.append(total[:open_nodes]), pa.table({"f": [f]}))[1], "", nodes, open_nodes, weight)
        return np.array(sums)

    held = boosting.Held(3, *columns)
    for level, (nodes, open_nodes) in enumerate(((1, 1), (2, 2), (4, 4), (7, 6))):
        found = seen(held, levels[level], nodes, open_nodes, True)
        assert (found == seen(boosting.Held(3, *columns), levels[level], nodes, open_nodes, True)).all() and found.any()


def test_a_large_training_table_stays_in_one_task(spark):
    df = spark.range(150_000).select(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(90)).cast("double").alias(n) for k, n in enumerate(NAMES)], (F.col("id") % 2).cast("int").alias("label"))
    rows = boosting.training_rows(df, NAMES, trees.walls_of(df, NAMES), "label", 0)
    assert rows.single and rows.df.count() > 100_000
    rows.df.unpersist()
