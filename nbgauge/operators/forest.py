"""Decision trees and forests of any depth, and the randomized search over forests.

A table of at most ``IN_TASK_ROWS`` rows goes whole to every task, which grows some of the
trees.  Rows of a larger one are dealt to the trees (with their bootstrap weights), and all
trees grow together.  Nodes with many rows grow level by level: histograms of the classes
are added by (tree, node, feature, bin), the best wall of each node makes a node table, and
the rows move on by a join with it.  A node is named by its path, so depth has no limit.  A
node with at most ``IN_TASK_ROWS`` rows is finished by the one task that gets them.

Weights, folds and the features a node may ask for follow from hashes, so a forest is
the same however the table is partitioned.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nbgauge.operators.trees import NODES, TreeModel, binned, bytes_table, distinct_rows, walls_of
from nbgauge.session import cut_lineage

#: Rows of a node that one task finishes alone.
IN_TASK_ROWS = 1_000_000
#: Rows that a task deals to the trees.
DEALT_ROWS = 20_000


@dataclass(frozen=True)
class Shape:
    """How a tree grows.  ``features`` per node: a number, or None for the root of all."""

    depth: int | None = None
    least_leaf: int = 1
    least_split: int = 2
    features: int | None = None
    bootstrap: bool = True


# The search grid of the forest.
GRID = {
    "bootstrap": [True, False],
    "depth": [10, 20, 30, 40, 50, 60, 70, 80, 90, 100, None],
    "features": ["auto", "sqrt"],
    "least_leaf": [1, 2, 4],
    "least_split": [2, 5, 10],
}


def candidates(n: int = 10, seed: int = 42) -> list[Shape]:
    """Random draws from the grid without replacement; both choices of features are the root of all."""
    grid = [dict(zip(GRID, row)) for row in itertools.product(*GRID.values())]
    return [Shape(**{k: v for k, v in one.items() if k != "features"}) for one in random.Random(seed).sample(grid, n)]


def mixed(*parts) -> np.ndarray:
    """64-bit hash of whole numbers, element by element."""
    out = np.uint64(0x243F6A8885A308D3)
    with np.errstate(over="ignore"):
        for part in parts:
            out = (np.asarray(part).astype(np.uint64) + out) * np.uint64(0x9E3779B97F4A7C15)
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out = out ^ (out >> np.uint64(32))
    return out


def bootstrap_weights(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson with mean 1, from a hash."""
    u = (mixed(rows, np.full(len(rows), tree), seed) >> np.uint64(11)).astype(float) / (1 << 53)
    chance = np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1, 18)]))
    return np.searchsorted(np.cumsum(chance), u, side="right")


def path_number(path: str) -> int:
    """64 bits of a path, for hashes only."""
    value = 1
    for side in path:
        value = (value * 0x100000001B3 + (1 if side == "L" else 2)) & 0xFFFFFFFFFFFFFFFF
    return value


def asked_features(tree: int, path: int, width: int, wanted: int, seed: int) -> np.ndarray:
    """The features a node may ask for, by a hash of tree and node."""
    if wanted >= width:
        return np.arange(width)
    order = mixed(np.arange(width), np.full(width, tree), np.full(width, path, np.uint64), seed)
    return np.sort(np.argsort(order, kind="stable")[:wanted])


def best_wall(counts: np.ndarray, least_leaf: int) -> tuple[int, int, float]:
    """Feature (by place), bin and gain of the wall that lowers the Gini impurity most; counts are feature x bin x class.

    Whole numbers are compared as fractions of doubles; ties go to the first feature, then to the lowest wall.
    """
    left = np.cumsum(counts, axis=1).astype(float)
    total = left[:, -1:]
    right = total - left
    n_left, n_right = left.sum(axis=2), right.sum(axis=2)
    with np.errstate(invalid="ignore", divide="ignore"):
        pure = np.where(n_left > 0, (left**2).sum(axis=2) / n_left, 0.0) + np.where(n_right > 0, (right**2).sum(axis=2) / n_right, 0.0)
    pure[(n_left < max(1, least_leaf)) | (n_right < max(1, least_leaf))] = -np.inf
    at = int(pure.argmax())
    feature, bin_ = divmod(at, counts.shape[1])
    all_rows = total[feature, 0].sum()
    return feature, bin_, float(pure[feature, bin_] - (total[feature, 0] ** 2).sum() / all_rows)


def is_leaf(classes: np.ndarray, depth: int, shape: Shape) -> bool:
    n = classes.sum()
    return bool((classes == n).any() or n < shape.least_split or n < 2 * shape.least_leaf or (shape.depth is not None and depth >= shape.depth))


def asked_of_nodes(tree: int, paths: np.ndarray, width: int, wanted: int, seed: int) -> np.ndarray:
    """``asked_features`` of many nodes, a row each."""
    if wanted >= width:
        return np.broadcast_to(np.arange(width), (len(paths), width))
    order = mixed(np.arange(width)[None], np.uint64(tree), paths[:, None], seed)
    return np.sort(np.argpartition(order, wanted - 1, axis=1)[:, :wanted], axis=1)


def _purity(left: tuple[np.ndarray, np.ndarray], total: tuple[np.ndarray, np.ndarray], least_leaf: int) -> np.ndarray:
    """What ``best_wall`` compares, for walls with these classes below them."""
    right = total[0] - left[0], total[1] - left[1]
    n_left, n_right = left[0] + left[1], right[0] + right[1]
    with np.errstate(invalid="ignore", divide="ignore"):
        pure = np.where(n_left > 0, (left[0] ** 2 + left[1] ** 2) / n_left, 0.0) + np.where(n_right > 0, (right[0] ** 2 + right[1] ** 2) / n_right, 0.0)
    pure[(n_left < max(1, least_leaf)) | (n_right < max(1, least_leaf))] = -np.inf
    return pure


def _walls_by_table(key: np.ndarray, label: np.ndarray, weight: np.ndarray, total: tuple[np.ndarray, np.ndarray], least_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Best wall of one feature in each node, and its bin; ``key`` is 256 x node + bin.  For few nodes: a place per bin."""
    size = len(total[0]) * 256
    ones = np.bincount(key, weights=weight * label, minlength=size)
    zeros = np.bincount(key, weights=weight, minlength=size) - ones
    left = [np.cumsum(c.reshape(-1, 256), axis=1) for c in (zeros, ones)]
    pure = _purity((left[0], left[1]), (total[0][:, None], total[1][:, None]), least_leaf)
    bin_ = pure.argmax(axis=1)
    return pure[np.arange(len(pure)), bin_], bin_


def _walls_by_order(key: np.ndarray, label: np.ndarray, weight: np.ndarray, total: tuple[np.ndarray, np.ndarray], least_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for many nodes: rows are sorted by node and bin, class and weight travelling in the low digits."""
    digits = int(weight.max()).bit_length()
    shift = digits + 1
    narrow = (len(total[0]) * 256) << shift <= 1 << 32
    packed = ((key << shift) | (label << digits) | weight).astype(np.uint32 if narrow else np.uint64)
    packed.sort()
    packed = packed.astype(np.int64)
    key, weight = packed >> shift, packed & ((1 << digits) - 1)
    last = np.append(np.flatnonzero(key[1:] != key[:-1]), len(key) - 1)
    below = np.cumsum(weight)[last]
    ones = np.cumsum(weight * ((packed >> digits) & 1))[last]
    key = key[last]
    node = key >> 8
    begin = np.searchsorted(node, np.arange(len(total[0])))
    below = below - np.append(0, below)[begin][node]
    ones = (ones - np.append(0, ones)[begin][node]).astype(float)
    pure = _purity((below - ones, ones), (total[0][node], total[1][node]), least_leaf)
    top = np.maximum.reduceat(pure, begin)
    hit = np.flatnonzero(pure == top[node])
    return top, key[hit[np.searchsorted(node[hit], np.arange(len(top)))]] & 255


def grow_here(
    columns: np.ndarray, label: np.ndarray, weight: np.ndarray, tree: int, path: str, shape: Shape, wanted: int, seed: int, watched: np.ndarray | None = None
) -> tuple[list, np.ndarray | None]:
    """path, feature, bin, value, cover, gain of a node and all below it, as columns; ``columns`` holds the bins feature by feature.

    All nodes of a level grow together.  Of ``watched`` rows the value of the leaf that each comes to is given too.
    """
    width, size = columns.shape
    flat = columns.ravel()
    at = np.flatnonzero(weight > 0)
    node = np.zeros(len(at), np.int64)
    paths, numbers, depth = [path], np.array([path_number(path)], np.uint64), len(path)
    out: list[list] = [[] for _ in range(6)]
    values = None if watched is None else np.zeros(len(watched))
    seen, seen_node = (np.zeros(0, np.int64),) * 2 if watched is None else (np.arange(len(watched)), np.zeros(len(watched), np.int64))
    while paths:
        n_nodes = len(paths)
        w, own_label = weight[at], label[at]
        n = np.bincount(node, weights=w, minlength=n_nodes)
        ones = np.bincount(node, weights=w * own_label, minlength=n_nodes)
        zeros = n - ones
        leaf = (zeros == 0) | (ones == 0) | (n < shape.least_split) | (n < 2 * shape.least_leaf)
        if shape.depth is not None and depth >= shape.depth:
            leaf[:] = True
        feature, bin_, gain = np.full(n_nodes, -1), np.zeros(n_nodes, np.int64), np.zeros(n_nodes)
        open_ = np.flatnonzero(~leaf)
        if len(open_):
            place = np.full(n_nodes, -1)
            place[open_] = np.arange(len(open_))
            inside = place[node]
            kept = inside >= 0
            at, node, inside, w, own_label = at[kept], node[kept], inside[kept], w[kept], own_label[kept]
            asked = asked_of_nodes(tree, numbers[open_], width, wanted, seed)
            total = zeros[open_], ones[open_]
            best, best_feature, best_bin = np.full(len(open_), -np.inf), np.zeros(len(open_), np.int64), np.zeros(len(open_), np.int64)
            walls = _walls_by_table if len(open_) * 2048 <= len(at) else _walls_by_order
            for k in range(asked.shape[1]):
                own = columns[k][at] if wanted >= width else flat[asked[inside, k] * size + at]
                pure, found = walls(inside * 256 + own, own_label, w, total, shape.least_leaf)
                # Ties go to the first feature.
                better = pure > best
                best[better], best_feature[better], best_bin[better] = pure[better], asked[better, k], found[better]
            rise = best - (total[0] ** 2 + total[1] ** 2) / n[open_]
            parted = rise > 1e-9
            at_node = open_[parted]
            feature[at_node], bin_[at_node], gain[at_node] = best_feature[parted], best_bin[parted], rise[parted]
        for column, found in zip(out, (paths, feature, bin_, ones / n, n, gain)):
            column.append(found)
        if values is not None:
            ended = feature[seen_node] < 0
            values[seen[ended]] = (ones / n)[seen_node[ended]]
            seen, seen_node = seen[~ended], seen_node[~ended]
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            break
        child = np.full(n_nodes, -1)
        child[split] = 2 * np.arange(len(split))

        def moved(rows: np.ndarray, node: np.ndarray) -> np.ndarray:
            return child[node] + (flat[feature[node] * size + rows] > bin_[node])

        kept = feature[node] >= 0
        at, node = at[kept], node[kept]
        node = moved(at, node)
        if len(seen):
            seen_node = moved(watched[seen], seen_node)
        paths = [paths[i] + side for i in split.tolist() for side in "LR"]
        numbers = (numbers[split][:, None] * np.uint64(0x100000001B3) + np.array([[1, 2]], np.uint64)).ravel()
        depth += 1
    return [[p for part in out[0] for p in part], *[np.concatenate(part) for part in out[1:]]], values


@dataclass(frozen=True)
class Plan:
    """Shape of each tree, and the fold (or -1) whose rows it does not see."""

    shapes: tuple[Shape, ...]
    left_out: tuple[int, ...]
    folds: int
    width: int
    seed: int

    def wanted(self, tree: int) -> int:
        return self.shapes[tree].features or max(1, int(np.sqrt(self.width)))


_DEALT = "tree int, path string, weight long, label int, bins binary"
_FOUND = "tree int, path string, feature int, bin int, value double, cover double, gain double"


def numbered(df: DataFrame, features: Sequence[str], walls: list[np.ndarray], label: str) -> DataFrame:
    """Bins, label and a number of every row with a label.  The number follows from the row's values and its place among equal rows."""
    rows = df.where(F.col(label).isNotNull())
    values = [F.col(f"`{c}`").cast("double") for c in features]
    # Equal rows are interchangeable: they are counted, and the copies numbered.
    table = binned(rows.withColumns({"_label": F.col(label).cast("int"), "_hash": F.xxhash64(*values)}), features, walls, "_label", "_hash")
    counted = cut_lineage(table.groupBy("bins", "_label", "_hash").count())
    # Copies are made after they are dealt out by runs, so many equal rows do not stay in one task.
    total = counted.agg(F.sum("count")).first()[0] or 0
    start = F.explode(F.sequence(F.lit(1).cast("long"), "count", F.lit(DEALT_ROWS).cast("long"))).alias("start")
    runs = counted.select("*", start).repartition(max(1, -(-total // DEALT_ROWS)), "bins", "_label", "_hash", "start")
    run = F.sequence("start", F.least("count", F.col("start") + (DEALT_ROWS - 1)))
    copies = runs.select("bins", F.col("_label").alias("label"), "_hash", F.explode(run).alias("copy"))
    return cut_lineage(copies.select("bins", "label", F.xxhash64("bins", "label", "_hash", "copy").alias("row")))


def fold_of(rows: np.ndarray, folds: int, seed: int) -> np.ndarray:
    return (mixed(rows.view(np.uint64), seed, 77) % np.uint64(folds)).astype(np.int64)


def _dealt(rows: DataFrame, plan: Plan) -> DataFrame:
    """Every row for each tree that draws it; rows of a task equal in bins and label are one row with the sum of their weights."""
    width = plan.width

    def dealt(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        number, label = table.column(2).to_numpy(), table.column(1).to_numpy().astype("<i4")
        first, kind = distinct_rows(np.column_stack([bytes_table(table.column(0), width), label.view(np.uint8).reshape(-1, 4)]))
        bins, labels = table.column(0).take(pa.array(first)).combine_chunks(), label[first]
        fold = fold_of(number, max(1, plan.folds), plan.seed)
        for tree, shape in enumerate(plan.shapes):
            weight = bootstrap_weights(number, tree, plan.seed) if shape.bootstrap else np.ones(len(number), np.int64)
            weight[fold == plan.left_out[tree]] = 0
            added = np.bincount(kind, weights=weight, minlength=len(first)).astype(np.int64)
            drawn = np.flatnonzero(added)
            if len(drawn):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(drawn), tree, np.int32)), pa.array([""] * len(drawn)), pa.array(added[drawn]), pa.array(labels[drawn]), bins.take(pa.array(drawn))],
                    names=["tree", "path", "weight", "label", "bins"],
                )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                n += len(batch)
            if n >= DEALT_ROWS:
                yield from dealt(held)
                held, n = [], 0
        if held:
            yield from dealt(held)

    return rows.select("bins", "label", "row").mapInArrow(deal, _DEALT)


def _node_table(level: DataFrame, plan: Plan) -> DataFrame:
    """Wall or value of each open node, from the added histograms."""
    width, seed = plan.width, plan.seed

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            bins, weight, label = bytes_table(batch.column(4), width), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keys = batch.select(["tree", "path"]).to_pandas()
            group = keys.groupby(["tree", "path"], sort=True).ngroup().to_numpy()
            first = np.unique(group, return_index=True)[1]
            trees, paths = keys["tree"].to_numpy()[first], keys["path"].to_numpy()[first]
            asked = [asked_features(int(t), path_number(p), width, plan.wanted(int(t)), seed) for t, p in zip(trees, paths)]
            # One feature of a node is one run; all nodes ask for few.
            most = max(map(len, asked))
            table = np.array([np.pad(a, (0, most - len(a)), constant_values=-1) for a in asked])[group]
            row, place = np.nonzero(table >= 0)
            feature = table[row, place]
            key = (group[row] * width + feature) * 256 + bins[row, feature]
            found, at = np.unique(key, return_inverse=True)
            n = [np.bincount(at, weights=weight[row] * (label[row] == c), minlength=len(found)).astype(np.int64) for c in (0, 1)]
            owner = found // 256 // width
            yield pa.RecordBatch.from_arrays(
                [pa.array(trees[owner].astype(np.int32)), pa.array(paths[owner]), pa.array((found // 256 % width).astype(np.int32)), pa.array((found % 256).astype(np.int32)), pa.array(n[0]), pa.array(n[1])],
                names=["tree", "path", "feature", "bin", "n0", "n1"],
            )

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        tree, path = key[0].as_py(), key[1].as_py()
        shape = plan.shapes[tree]
        feature, bin_ = table["feature"].to_numpy(), table["bin"].to_numpy()
        names, place = np.unique(feature, return_inverse=True)
        counts = np.zeros((len(names), 256, 2))
        counts[place, bin_, 0], counts[place, bin_, 1] = table["n0"].to_numpy(), table["n1"].to_numpy()
        classes = counts[0].sum(axis=0)
        f, b, gain = (0, 0, 0.0) if is_leaf(classes, len(path), shape) else best_wall(counts, shape.least_leaf)
        leaf = not gain > 1e-9
        return pa.table({
            "tree": pa.array([tree], pa.int32()), "path": [path], "feature": pa.array([-1 if leaf else int(names[f])], pa.int32()),
            "bin": pa.array([0 if leaf else b], pa.int32()), "value": [float(classes[1] / classes.sum())], "cover": [float(classes.sum())], "gain": [0.0 if leaf else gain],
        })

    partial = level.mapInArrow(count, "tree int, path string, feature int, bin int, n0 long, n1 long")
    added = partial.groupBy("tree", "path", "feature", "bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return added.groupBy("tree", "path").applyInArrow(choose, _FOUND)


def _nodes_batch(tree: int, found: list) -> pa.RecordBatch:
    paths, feature, bin_, *others = found
    columns = [pa.array(np.full(len(paths), tree, np.int32)), pa.array(paths, pa.string()), pa.array(feature.astype(np.int32)), pa.array(bin_.astype(np.int32))]
    return pa.RecordBatch.from_arrays([*columns, *[pa.array(c, pa.float64()) for c in others]], names=["tree", "path", "feature", "bin", "value", "cover", "gain"])


@dataclass
class Held:
    """The rows of a table that a task has whole, equal ones (bins and label) as one kind."""

    columns: np.ndarray
    label: np.ndarray
    kind: np.ndarray
    number: np.ndarray
    fold: np.ndarray
    plan: Plan

    @classmethod
    def of(cls, packs: list[pa.RecordBatch], plan: Plan) -> Held:
        bins, label, number = (np.frombuffer(b"".join(p for pack in packs for p in pack.column(i).to_pylist()), kind) for i, kind in enumerate((np.uint8, "<i4", "<i8")))
        bins = bins.reshape(-1, plan.width)
        first, kind = distinct_rows(np.column_stack([bins, label.astype(np.uint8)]))
        fold = fold_of(number, max(1, plan.folds), plan.seed)
        return cls(np.ascontiguousarray(bins[first].T), label[first].astype(np.int64), kind, number, fold, plan)

    def weights(self, tree: int) -> np.ndarray:
        """How often each kind is drawn for a tree."""
        plan = self.plan
        weight = bootstrap_weights(self.number, tree, plan.seed) if plan.shapes[tree].bootstrap else np.ones(len(self.number), np.int64)
        weight[self.fold == plan.left_out[tree]] = 0
        return np.bincount(self.kind, weights=weight, minlength=len(self.label)).astype(np.int64)

    def grown(self, tree: int, watched: np.ndarray | None = None) -> tuple[list, np.ndarray | None]:
        plan = self.plan
        return grow_here(self.columns, self.label, self.weights(tree), tree, "", plan.shapes[tree], plan.wanted(tree), plan.seed, watched)

    def votes(self, trees: range) -> tuple[int, int]:
        """Rows of the fold that a forest did not see: those it tells right, and all."""
        held_out = np.bincount(self.kind[self.fold == self.plan.left_out[trees[0]]], minlength=len(self.label))
        watched = np.flatnonzero(held_out)
        share = np.zeros(len(watched))
        for tree in trees:
            if self.weights(tree).any():
                share += self.grown(tree, watched)[1]
        right = (share / len(trees) > 0.5) == (self.label[watched] == 1)
        return int(held_out[watched][right].sum()), int(held_out.sum())


def _in_whole(rows: DataFrame, plan: Plan, groups: int, work, schema: str) -> DataFrame:
    """``work(held, group)`` in a task per group, each with all rows of the table."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                parts = b"".join(batch.column(0).to_pylist()), batch.column(1).to_numpy().astype("<i4").tobytes(), batch.column(2).to_numpy().astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], names=["bins", "label", "row"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = [batch for batch in batches if len(batch)]
        if packs:
            yield from work(Held.of(packs, plan), packs[0].column(3)[0].as_py())

    packs = rows.select("bins", "label", "row").mapInArrow(pack, "bins binary, label binary, row binary")
    dealt = packs.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return dealt.repartitionById(groups, "group").mapInArrow(each, schema)


def held_nodes(rows: DataFrame, plan: Plan) -> DataFrame:
    """Nodes of all trees of a plan over a table that a task can hold."""
    trees = len(plan.shapes)
    groups = min(trees, 4 * rows.sparkSession.sparkContext.defaultParallelism)

    def work(held: Held, group: int) -> Iterator[pa.RecordBatch]:
        for tree in range(group, trees, groups):
            if held.weights(tree).any():
                yield _nodes_batch(tree, held.grown(tree)[0])

    return cut_lineage(_in_whole(rows, plan, groups, work, _FOUND))


def held_accuracy(rows: DataFrame, plan: Plan, per_forest: int) -> dict[int, float]:
    """Accuracy of each forest on the rows that it did not see; its trees are scored as they grow and not kept."""

    def work(held: Held, forest: int) -> Iterator[pa.RecordBatch]:
        hits, seen = held.votes(range(forest * per_forest, (forest + 1) * per_forest))
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (forest, hits, seen)], names=["forest", "hits", "seen"])

    counted = _in_whole(rows, plan, len(plan.shapes) // per_forest, work, "forest long, hits long, seen long").collect()
    return {r["forest"]: r["hits"] / r["seen"] for r in counted if r["seen"]}


def grow(rows: DataFrame, plan: Plan, in_task_rows: int = IN_TASK_ROWS) -> DataFrame:
    """Nodes (without walls) of all trees of a plan."""
    if rows.count() <= in_task_rows:
        return held_nodes(rows, plan)
    width = plan.width

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        tree, path = key[0].as_py(), key[1].as_py()
        columns = np.ascontiguousarray(bytes_table(table["bins"], width).T)
        label, weight = table["label"].to_numpy().astype(np.int64), table["weight"].to_numpy()
        return pa.Table.from_batches([_nodes_batch(tree, grow_here(columns, label, weight, tree, path, plan.shapes[tree], plan.wanted(tree), plan.seed)[0])])

    parts = []
    level = cut_lineage(_dealt(rows, plan))
    while True:
        sizes = cut_lineage(level.groupBy("tree", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("small", F.col("n") <= in_task_rows).drop("n"))
        marked = level.join(sizes, ["tree", "path"])
        parts.append(cut_lineage(marked.where("small").drop("small").groupBy("tree", "path").applyInArrow(finish, _FOUND)))
        large = marked.where("NOT small").drop("small")
        if not sizes.where("NOT small").head(1):
            break
        found = cut_lineage(_node_table(large.select("tree", "path", "weight", "label", "bins"), plan))
        parts.append(found)
        walls = found.where("feature >= 0").select("tree", "path", "feature", "bin")
        moved = large.join(walls, ["tree", "path"])
        own = F.conv(F.hex(F.expr("substring(bins, feature + 1, 1)")), 16, 10).cast("int")
        side = F.when(own <= F.col("bin"), F.lit("L")).otherwise(F.lit("R"))
        level = cut_lineage(moved.select("tree", F.concat("path", side).alias("path"), "weight", "label", "bins"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return cut_lineage(out)


def with_walls(found: DataFrame, walls: list[np.ndarray]) -> DataFrame:
    """NODES of a model: missing values stand below all others, so they go left."""
    below = F.array(*[F.array(F.lit(float("-inf")), *[F.lit(float(w)) for w in ws]) for ws in walls])
    wall = F.when(F.col("feature") >= 0, F.get(F.get(below, F.col("feature")), F.col("bin")))
    return found.select("tree", "path", "feature", "bin", wall.alias("wall"), F.lit(True).alias("missing_left"), "value", "cover", "gain")


def _model(df: DataFrame, features, walls, found: DataFrame, trees: int, **info) -> TreeModel:
    nodes = cut_lineage(with_walls(found, walls))
    return TreeModel(list(features), walls, "share", nodes, nodes.count(), {"trees": trees, **info})


@dataclass
class DecisionTree:
    """One tree on all rows and features."""

    depth: int | None = None
    least_leaf: int = 1
    least_split: int = 2
    bins: int = 254
    seed: int = 0
    in_task_rows: int = IN_TASK_ROWS

    def fit(self, df: DataFrame, features: Sequence[str], label: str = "label") -> TreeModel:
        walls = walls_of(df.where(F.col(label).isNotNull()), features, bins=self.bins)
        shape = Shape(self.depth, self.least_leaf, self.least_split, len(features), bootstrap=False)
        plan = Plan((shape,), (-1,), 1, len(features), self.seed)
        return _model(df, features, walls, grow(numbered(df, features, walls, label), plan, self.in_task_rows), 1, learner="tree")


@dataclass
class Forest:
    """Trees on bootstrapped rows and few features per node."""

    trees: int = 100
    shape: Shape = Shape()
    bins: int = 254
    seed: int = 42
    in_task_rows: int = IN_TASK_ROWS

    def fit(self, df: DataFrame, features: Sequence[str], label: str = "label") -> TreeModel:
        walls = walls_of(df.where(F.col(label).isNotNull()), features, bins=self.bins)
        rows = numbered(df, features, walls, label)
        return self.fit_numbered(df, features, walls, rows)

    def fit_numbered(self, df: DataFrame, features, walls, rows: DataFrame, **info) -> TreeModel:
        plan = Plan((self.shape,) * self.trees, (-1,) * self.trees, 1, len(features), self.seed)
        return _model(df, features, walls, grow(rows, plan, self.in_task_rows), self.trees, learner="forest", shape=self.shape.__dict__, **info)


def fold_accuracy(rows: DataFrame, found: DataFrame, plan: Plan, per_forest: int) -> DataFrame:
    """forest, accuracy on the rows that the forest did not see.  Forests are runs of ``per_forest`` trees."""
    model = TreeModel([], [], "share", found.select("*", F.lit(None).cast("double").alias("wall"), F.lit(True).alias("missing_left")), found.count())
    trees, width = model.trees(), plan.width

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, seen = np.zeros(len(trees) // per_forest, np.int64), np.zeros(len(trees) // per_forest, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            bins, label = bytes_table(batch.column(0), width), batch.column(1).to_numpy()
            fold = fold_of(batch.column(2).to_numpy(), plan.folds, plan.seed)
            unseen = {}
            for k in set(plan.left_out):
                out = np.flatnonzero(fold == k)
                first, kind = distinct_rows(bins[out])
                unseen[k] = out, bins[out][first], kind
            for forest in range(len(right)):
                out, some, kind = unseen[plan.left_out[forest * per_forest]]
                share = sum(tree.value[tree.leaves(some)] for tree in trees[forest * per_forest : (forest + 1) * per_forest]) / per_forest
                right[forest] += ((share > 0.5)[kind] == (label[out] == 1)).sum()
                seen[forest] += len(out)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(right))), pa.array(right), pa.array(seen)], names=["forest", "hits", "seen"])

    counted = rows.select("bins", "label", "row").mapInArrow(vote, "forest long, hits long, seen long")
    return counted.groupBy("forest").agg((F.sum("hits") / F.sum("seen")).alias("accuracy"))


@dataclass
class ForestSearch:
    """The forest of the candidate shape with the best mean accuracy over the folds, grown on all rows.

    The forests of all candidates and folds grow together, a task each that scores its trees
    as they grow; of a table beyond ``in_task_rows`` as many at a time as their nodes can be
    shipped for scoring.
    """

    candidates: int = 10
    folds: int = 3
    trees: int = 100
    bins: int = 254
    seed: int = 42
    in_task_rows: int = IN_TASK_ROWS
    together: int = 10

    def fit(self, df: DataFrame, features: Sequence[str], label: str = "label") -> TreeModel:
        walls = walls_of(df.where(F.col(label).isNotNull()), features, bins=self.bins)
        rows = numbered(df, features, walls, label)
        shapes = candidates(self.candidates, self.seed)
        runs = [(shape, fold) for shape in shapes for fold in range(self.folds)]
        accuracy: list[float] = []
        held = rows.count() <= self.in_task_rows
        # Nothing of a table that tasks can hold is shipped for scoring, so all forests grow together.
        together = len(runs) if held else self.together
        for at in range(0, len(runs), together):
            some = runs[at : at + together]
            plan = Plan(
                tuple(shape for shape, _ in some for _ in range(self.trees)), tuple(fold for _, fold in some for _ in range(self.trees)),
                self.folds, len(features), self.seed,
            )
            if held:
                got = held_accuracy(rows, plan, self.trees)
                accuracy += [got.get(i, 0.0) for i in range(len(some))]
                continue
            found = grow(rows, plan, self.in_task_rows)
            got = {r["forest"]: r["accuracy"] for r in fold_accuracy(rows, found, plan, self.trees).collect()}
            accuracy += [got.get(i) or 0.0 for i in range(len(some))]
        means = [float(np.mean(accuracy[i * self.folds : (i + 1) * self.folds])) for i in range(len(shapes))]
        best = int(np.argmax(means))
        forest = Forest(self.trees, shapes[best], self.bins, self.seed, self.in_task_rows)
        return forest.fit_numbered(df, features, walls, rows, accuracy=means)


def grown_larger(model: TreeModel, df: DataFrame, trees: int = 500, seed: int = 42, label: str = "label") -> TreeModel:
    """A larger forest of the shape that a search found best."""
    return replace(Forest(shape=Shape(**model.info["shape"])), trees=trees, seed=seed).fit(df, model.features, label)
