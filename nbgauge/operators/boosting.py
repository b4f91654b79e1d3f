"""Boosted trees grown from histograms that Spark adds up.

A table that one task can hold grows all its trees there.  Of a larger one
a level of a tree is one pass over the binned rows: each task adds the gradients of its
rows into a histogram per feature, the histograms of a feature are added in one group,
which answers with its best wall.  Gradients are rounded to integers, so sums do not
depend on the order of rows and tasks, and two runs grow the same trees.

``SymmetricBoosting``: one wall for all nodes of a level; every row's gradient comes from
trees whose leaf values, as far as that row is concerned, were taken from rows before it
in a hashed order.  ``SecondOrderBoosting``: a wall per node by gradients and second
derivatives, with a learned side for missing values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nbgauge.operators.trees import Tree, TreeModel, binned, bytes_table, single_leaf, tree_of, walls_of
from nbgauge.session import cut_lineage

#: Gradients are counted in units of 2^-30, second derivatives too.
UNIT = float(1 << 30)
#: Rows of a training table that one task holds (about 100 bytes each), and rows of a partition of a larger table.
PARTITION_ROWS, SPREAD_ROWS = 4_000_000, 100_000
#: Trees between two updates of the margins of a larger table.
FRESH_TREES = 10
#: Parts of the hashed order; each holds as many rows as all before it together.
BLOCKS = 8


def _gradients(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Descent direction and second derivative of the log loss, in UNITs."""
    p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
    return np.rint((label - p) * UNIT), np.rint(p * (1 - p) * UNIT)


def _added(slot: np.ndarray, weight: np.ndarray, copies: np.ndarray, slots: int) -> np.ndarray:
    """Weight times copies by slot, in whole numbers."""
    if copies.sum() < 1 << 22:
        return np.bincount(slot, weights=weight * copies, minlength=slots).astype(np.int64)
    # Beyond 2^53 doubles are not exact: high and low digits are added apart.
    high = np.floor(weight / (1 << 15))
    parts = [np.bincount(slot, weights=w * copies, minlength=slots).astype(np.int64) for w in (high, weight - high * (1 << 15))]
    return parts[0] * (1 << 15) + parts[1]


def _histogram(bins: np.ndarray, node: np.ndarray, nodes: int, weights: Sequence[np.ndarray], copies: np.ndarray) -> np.ndarray:
    """feature x node x bin x weight, in whole numbers."""
    width = bins.shape[1]
    out = np.empty((width, nodes, 256, len(weights)), np.int64)
    for f in range(width):
        slot = node * 256 + bins[:, f]
        for k, w in enumerate(weights):
            out[f, :, :, k] = _added(slot, w, copies, nodes * 256).reshape(nodes, 256)
    return out


@dataclass
class Rows:
    """The training table: bins, label, block, copies and margin up to the first ``known`` trees.

    Rows equal in bins, label and block have the same margin after every tree, so they are one row with a number of copies.
    """

    df: DataFrame
    width: int
    single: bool
    known: int = 0

    def sums(self, fresh: list, split, best, schema: str, nodes: int, open_nodes: int, curved: bool) -> list:
        """One pass: ``split`` gives the node of each row, ``best`` what a feature's added histogram answers.

        The blocks count as one more feature, the last.  Only the first ``open_nodes`` are looked at, and second
        derivatives only in the blocks if not ``curved``; that spares a table inside one task some work.
        """
        width, single, kinds = self.width, self.single, 3

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width + 1, nodes, 256, kinds), np.int64)
            for batch in batches:
                if not len(batch):
                    continue
                bins, label, block, copies, margin = _read(batch, width)
                for tree, values in fresh:
                    margin = margin + values[block, tree.leaves(bins)]
                g, h = _gradients(margin, label)
                total += _histogram(np.column_stack([bins, block]).astype(np.uint8), split(bins), nodes, (g, h, np.ones(len(g))), copies)
            if single:
                # All rows are here, so nothing is left to add up.
                for f in range(width + 1):
                    yield from best(f, total[f]).to_batches()
            else:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=["feature", "sums"])

        def merge(key: tuple, table: pa.Table) -> pa.Table:
            total = np.zeros((nodes, 256, kinds), np.int64)
            for part in table["sums"]:
                total += np.frombuffer(part.as_buffer(), np.int64).reshape(total.shape)
            return best(key[0].as_py(), total)

        if single:
            return self.df.mapInArrow(add, schema).collect()
        return self.df.mapInArrow(add, "feature int, sums binary").groupBy("feature").applyInArrow(merge, schema).collect()

    def leaf_sums(self, fresh: list, tree: Tree) -> np.ndarray:
        """Gradient, second derivative and rows by block and node of a finished tree."""
        width, n = self.width, len(tree.feature)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((BLOCKS * n, 3), np.int64)
            for batch in batches:
                if not len(batch):
                    continue
                bins, label, block, copies, margin = _read(batch, width)
                for other, values in fresh:
                    margin = margin + values[block, other.leaves(bins)]
                slot = block * n + tree.leaves(bins)
                for k, w in enumerate((*_gradients(margin, label), np.ones(len(bins)))):
                    total[:, k] += _added(slot, w, copies, BLOCKS * n)
            at = np.flatnonzero(total[:, 2])
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(total[at, k]) for k in range(3)]], names=["slot", "g", "h", "n"])

        out = np.zeros((BLOCKS * n, 3))
        partial = self.df.mapInArrow(add, "slot long, g long, h long, n long")
        if not self.single:
            partial = partial.groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
        for r in partial.collect():
            out[r["slot"]] = r["g"], r["h"], r["n"]
        return out.reshape(BLOCKS, n, 3)

    def advanced(self, fresh: list) -> Rows:
        """The table with the margins of ``fresh`` trees added, written anew."""
        width = self.width

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                bins, _, block, _, margin = _read(batch, width)
                for tree, values in fresh:
                    margin = margin + values[block, tree.leaves(bins)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(margin)], names=batch.schema.names)

        new = cut_lineage(self.df.mapInArrow(add, self.df.schema)).persist()
        self.df.unpersist()
        return Rows(new, width, self.single, self.known + len(fresh))


    def grown(self, boosting, rounds: int) -> list[Tree]:
        """All trees of a table of one partition, from the task that holds it: the passes of a tree need no job each."""
        width = self.width

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [_read(batch, width) for batch in batches if len(batch)]
            if not parts:
                return
            held = Held(width, *[np.concatenate(column) for column in zip(*parts)])
            for number in range(rounds):
                tree, values = boosting._round(held, [])
                held.advance(tree, values)
                columns = [pa.array(getattr(tree, c)) for c in _TREE]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tree.feature), number, np.int32)), *columns], names=["tree", *_TREE])

        schema = "tree int, " + ", ".join(f"{c} {kind}" for c, kind in _TREE.items())
        table = self.df.mapInArrow(grow, schema).toArrow()
        number = table["tree"].to_numpy()
        cuts = np.flatnonzero(np.diff(number, prepend=-1))
        columns = [table[c].to_numpy() for c in _TREE]
        return [Tree(*[c[a:b] for c in columns]) for a, b in zip(cuts, [*cuts[1:], len(number)])]


#: Arrays of a tree as columns.
_TREE = {"feature": "long", "bin": "long", "missing_left": "boolean", "left": "long", "right": "long", "value": "double", "cover": "double", "gain": "double"}


class Held:
    """The training table inside the one task that has all of it; answers as ``Rows`` does.

    From one level of a tree to the next the node of each row is kept.  Of two nodes that come from one only the
    histogram of the smaller is counted; that of the other is what is left.
    """

    def __init__(self, width: int, bins: np.ndarray, label: np.ndarray, block: np.ndarray, copies: np.ndarray, margin: np.ndarray):
        self.width, self.label, self.block, self.copies, self.margin = width, label, block, copies, margin
        # Feature by feature, the blocks last.
        self.columns = np.empty((width + 1, len(label)), np.uint8)
        self.columns[:width], self.columns[width] = bins.T, block
        self.bins = self.columns[:width].T
        self.alike = bool((copies == 1).all())
        self._begin()

    def _begin(self) -> None:
        self.weights: list | None = None
        self.node: np.ndarray | None = None
        self.sizes = self.total = np.zeros(0, np.int64)
        self.reached: tuple | None = None

    def _weighed(self) -> list[list[tuple[np.ndarray, int]]]:
        """Parts of gradient and second derivative, times copies, with the factor of each part; see ``_added``."""
        few = self.copies.sum() < 1 << 22
        out = []
        for w in _gradients(self.margin, self.label):
            high = np.floor(w / (1 << 15))
            out.append([(w * self.copies, 1)] if few else [(high * self.copies, 1 << 15), ((w - high * (1 << 15)) * self.copies, 1)])
        return out

    def _counted(self, rows: np.ndarray | None, node: np.ndarray, nodes: int, curved: bool) -> np.ndarray:
        """feature x node x bin x weight of some rows, or of all."""
        take = (lambda x: x) if rows is None else (lambda x: x[rows])
        base = node * 256
        weights = [[(take(part), factor) for part, factor in parts] for parts in self.weights]
        copies = None if self.alike else take(self.copies)
        out = np.zeros((self.width + 1, nodes, 256, 3), np.int64)
        for f, column in enumerate(self.columns):
            slot = base + take(column)
            for k, parts in enumerate(weights):
                if k == 0 or curved or f == self.width:
                    sums = sum(np.bincount(slot, weights=part, minlength=nodes * 256).astype(np.int64) * factor for part, factor in parts)
                    out[f, :, :, k] = sums.reshape(nodes, 256)
            out[f, :, :, 2] = np.bincount(slot, weights=copies, minlength=nodes * 256).astype(np.int64).reshape(nodes, 256)
        return out

    def sums(self, fresh: list, split, best, schema: str, nodes: int, open_nodes: int, curved: bool) -> list:
        if self.weights is None:
            self.weights = self._weighed()
        before, node = self.node, split(self.bins, self.node)
        sizes = np.bincount(node, minlength=nodes)
        total = np.zeros((self.width + 1, nodes, 256, 3), np.int64)
        parent = np.full(nodes, -1)
        if before is not None:
            parent[node] = before
        counted, left_over = [], []
        for p in range(len(self.sizes)) if before is not None else ():
            children = [j for j in np.flatnonzero(parent == p).tolist() if j < open_nodes]
            children.sort(key=lambda j: sizes[j])
            if len(children) == 2 and sizes[children].sum() == self.sizes[p]:
                left_over.append((children[1], p, children[0]))
                children = children[:1]
            counted += children
        if before is None:
            counted = list(range(open_nodes))
        if len(counted) == nodes:
            total = self._counted(None, node, nodes, curved)
        elif counted:
            place = np.full(nodes, -1)
            place[counted] = np.arange(len(counted))
            at = place[node]
            rows = np.flatnonzero(at >= 0)
            total[:, counted] = self._counted(None if len(rows) == len(node) else rows, at[rows], len(counted), curved)
        for j, p, other in left_over:
            total[:, j] = self.total[:, p] - total[:, other]
        self.node, self.sizes, self.total = node, sizes, total
        return [row for f in range(self.width + 1) for row in best(f, total[f]).to_pylist()]

    def _leaves(self, tree: Tree) -> np.ndarray:
        if self.reached is None or self.reached[0] is not tree:
            self.reached = tree, tree.leaves(self.bins)
        return self.reached[1]

    def leaf_sums(self, fresh: list, tree: Tree) -> np.ndarray:
        n = len(tree.feature)
        slot = self.block * n + self._leaves(tree)
        weights = (*_gradients(self.margin, self.label), np.ones(len(slot)))
        return np.stack([_added(slot, w, self.copies, BLOCKS * n).astype(float) for w in weights], axis=1).reshape(BLOCKS, n, 3)

    def advance(self, tree: Tree, values: np.ndarray) -> None:
        self.margin = self.margin + values[self.block, self._leaves(tree)]
        self._begin()


def _read(batch: pa.RecordBatch, width: int):
    bins = bytes_table(batch.column(0), width)
    return bins, batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy(), batch.column(4).to_numpy()


def training_rows(df: DataFrame, features: Sequence[str], walls: list[np.ndarray], label: str, seed: int) -> Rows:
    """Bins, label and block of the rows, equal ones counted; the block follows from the row's values, so it does not depend on the partitions."""
    rows = df.where(F.col(label).isNotNull())
    hashed = F.xxhash64(F.lit(seed), F.lit(label), F.col(label).cast("double"), *[F.col(f"`{c}`").cast("double") for c in features])
    # Of 2^b equal shares of the hashes the first is block 0, the next block 1, the next two block 2, and so on.
    share = F.pmod(hashed, F.lit(1 << (BLOCKS - 1)))
    block = F.when(share == 0, F.lit(0)).otherwise(F.floor(F.log2(share.cast("double"))) + 1).cast("int")
    table = binned(rows.withColumns({"_label": F.col(label).cast("double"), "_block": block}), features, walls, "_label", "_block")
    counted = cut_lineage(table.groupBy("bins", "_label", "_block").agg(F.count(F.lit(1)).alias("_copies")).withColumn("_margin", F.lit(0.0)))
    n = counted.count()
    partitions = 1 if n <= PARTITION_ROWS else -(-n // min(PARTITION_ROWS, SPREAD_ROWS))
    return Rows(counted.coalesce(partitions).persist(), len(features), partitions == 1)


def _boosted(boosting, rows: Rows, rounds: int) -> list[Tree]:
    """The trees of all rounds: in one task if one has all rows, else a pass over the table per level."""
    trees: list[Tree] = rows.grown(boosting, rounds) if rows.single else []
    fresh: list = []
    # A table without rows has no task that could grow anything.
    while len(trees) < rounds:
        tree, values = boosting._round(rows, fresh)
        trees.append(tree)
        fresh = [*fresh, (tree, values)]
        if len(fresh) == FRESH_TREES:
            rows, fresh = rows.advanced(fresh), []
    rows.df.unpersist()
    return trees


@dataclass
class SymmetricBoosting:
    """Symmetric trees on ordered gradients."""

    rounds: int = 100
    rate: float = 0.001
    depth: int = 6
    ridge: float = 3.0
    bins: int = 254
    seed: int = 0

    def fit(self, df: DataFrame, features: Sequence[str], label: str = "label") -> TreeModel:
        walls = walls_of(df.where(F.col(label).isNotNull()), features, bins=self.bins)
        rows = training_rows(df, features, walls, label, self.seed)
        trees = _boosted(self, rows, self.rounds)
        return TreeModel.of(df.sparkSession, features, walls, "margin", trees, learner="symmetric")

    def _round(self, rows: Rows | Held, fresh: list) -> tuple[Tree, np.ndarray]:
        tree, sums = self._structure(rows, fresh)
        tree.value, by_block, tree.cover = self._values(rows.leaf_sums(fresh, tree) if sums is None else sums, tree)
        return tree, by_block

    def _structure(self, rows: Rows, fresh: list) -> tuple[Tree, np.ndarray | None]:
        """Walls level by level, each the best for all nodes together, as long as the score rises.

        The pass that finds no better wall has seen the leaves, and gives their sums.
        """
        walls: list[tuple[int, int, float]] = []
        ridge, blocks = self.ridge, rows.width

        def split(bins: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
            node = np.zeros(len(bins), np.int64) if before is None else before
            for f, b, _ in walls if before is None else walls[-1:]:
                node = 2 * node + (bins[:, f] > b)
            return node

        def best(feature: int, sums: np.ndarray) -> pa.Table:
            # Missing values stand below all others.
            left = np.cumsum(sums, axis=1)
            total = left[:, -1:]

            def score(part):
                g = part[..., 0] / UNIT
                return (g * g / (part[..., 2] + ridge)).sum(axis=0)

            scores = score(left) + score(total - left)
            at = int(scores[:-1].argmax())
            by_block = sums[:, :BLOCKS].ravel() if feature == blocks else sums[:0, 0, 0]
            return pa.table({
                "feature": pa.array([feature], pa.int32()), "bin": pa.array([at], pa.int32()), "score": [float(scores[at])], "before": [float(score(total)[0])],
                "sums": pa.array([by_block.tolist()], pa.list_(pa.int64())),
            })

        for _ in range(self.depth):
            answers = rows.sums(fresh, split, best, "feature int, bin int, score double, before double, sums array<long>", 1 << len(walls), 1 << len(walls), False)
            found = [r for r in answers if r["feature"] != blocks]
            # Ties go to the first feature; scores of a wall that parts nothing are those without it.
            top = max(found, key=lambda r: (r["score"], -r["feature"]))
            before = min(r["before"] for r in found)
            if not top["score"] > before * (1 + 1e-9) + 1e-12:
                last = next(r for r in answers if r["feature"] == blocks)["sums"]
                leaves = np.array(last, float).reshape(1 << len(walls), BLOCKS, 3).transpose(1, 0, 2)
                # Leaves are the last nodes of a tree, in the order of their paths.
                return _symmetric_tree(walls), np.concatenate([np.zeros((BLOCKS, (1 << len(walls)) - 1, 3)), leaves], axis=1)
            walls.append((top["feature"], top["bin"], top["score"] - before))
        return _symmetric_tree(walls), None

    def _values(self, sums: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Newton steps: from all rows, and for each block from the blocks before it."""
        leaf = tree.feature < 0
        total, before = sums.sum(axis=0), np.cumsum(sums, axis=0) - sums

        def step(part):
            return np.where(leaf, self.rate * (part[..., 0] / UNIT) / (part[..., 1] / UNIT + self.ridge), 0.0)

        cover = total[:, 2].copy()
        for node in range(len(cover) - 1, -1, -1):
            if not leaf[node]:
                cover[node] = cover[tree.left[node]] + cover[tree.right[node]]
        return step(total), step(before), cover


def _symmetric_tree(walls: list[tuple[int, int, float]]) -> Tree:
    if not walls:
        return single_leaf(0.0)
    paths, feature, bin_, gain = [""], [], [], []
    level = [""]
    for f, b, rise in walls:
        feature += [f] * len(level)
        bin_ += [b] * len(level)
        gain += [rise / len(level)] * len(level)
        level = [p + side for p in level for side in "LR"]
        paths += level
    rest = len(paths) - len(feature)
    zeros = [0.0] * len(paths)
    return tree_of(paths, feature + [-1] * rest, bin_ + [0] * rest, [True] * len(paths), zeros, zeros, gain + [0.0] * rest)


@dataclass
class SecondOrderBoosting:
    """Trees by gradient and second derivative, a wall per node."""

    rounds: int = 100
    rate: float = 0.3
    depth: int = 6
    ridge: float = 1.0
    least_gain: float = 0.0
    least_hessian: float = 1.0
    bins: int = 254
    weight: str | None = None
    seed: int = 0

    def fit(self, df: DataFrame, features: Sequence[str], label: str = "label") -> TreeModel:
        walls = walls_of(df.where(F.col(label).isNotNull()), features, self.weight, self.bins)
        rows = training_rows(df, features, walls, label, self.seed)
        trees = _boosted(self, rows, self.rounds)
        return TreeModel.of(df.sparkSession, features, walls, "margin", trees, learner="second order")

    def _round(self, rows: Rows | Held, fresh: list) -> tuple[Tree, np.ndarray]:
        tree = self._grow(rows, fresh)
        return tree, np.repeat(tree.value[None], BLOCKS, axis=0)

    def _grow(self, rows: Rows, fresh: list) -> Tree:
        # path: (feature, bin, missing left, gradient, second derivative, rows, gain), feature -1 for a leaf.
        nodes: dict[str, tuple] = {}
        frontier = [""]
        ridge, least_gain, least_hessian = self.ridge, self.least_gain, self.least_hessian

        def best(feature: int, sums: np.ndarray) -> pa.Table:
            total = sums.sum(axis=1)
            missing = sums[:, :1]
            present = np.cumsum(sums[:, 1:], axis=1)
            score = lambda part: (part[..., 0] / UNIT) ** 2 / (part[..., 1] / UNIT + ridge)
            out = {c: [] for c in ("node", "bin", "missing_left", "gain", "g", "h", "n", "left_g", "left_h", "left_n")}
            sides = []
            for left in (present + missing, present):
                right = total[:, None] - left
                gain = (score(left) + score(right) - score(total)[:, None]) / 2 - least_gain
                allowed = (left[..., 1] >= least_hessian * UNIT) & (right[..., 1] >= least_hessian * UNIT) & (left[..., 2] > 0) & (right[..., 2] > 0)
                sides.append((left, np.where(allowed, gain, -np.inf)))
            for node in range(len(sums)):
                # Missing values go left if nothing speaks against it.
                missing_left = sides[0][1][node].max() >= sides[1][1][node].max()
                left, gain = sides[0 if missing_left else 1]
                at = int(gain[node].argmax())
                values = (node, at + 1, missing_left, gain[node, at], *total[node], *left[node, at])
                for column, value in zip(out.values(), values):
                    column.append(value)
            return pa.table({
                "feature": pa.array([feature] * len(sums), pa.int32()), "node": pa.array(out["node"], pa.int32()), "bin": pa.array(out["bin"], pa.int32()),
                "missing_left": pa.array(out["missing_left"], pa.bool_()), "gain": pa.array(out["gain"], pa.float64()),
                **{c: pa.array(out[c], pa.int64()) for c in ("g", "h", "n", "left_g", "left_h", "left_n")},
            })

        schema = "feature int, node int, bin int, missing_left boolean, gain double, g long, h long, n long, left_g long, left_h long, left_n long"
        step = None
        for level in range(self.depth):
            spot = {path: i for i, path in enumerate(frontier)}
            upper = self._tree(nodes | {path: (-1, 0, True, 0, 0, 0, 0.0) for path in frontier}, spot)

            def split(bins: np.ndarray, before: np.ndarray | None = None, upper=upper, step=step) -> np.ndarray:
                # Rows of finished leaves go to one more node, which is not looked at.
                if before is None:
                    return upper.value[upper.leaves(bins)].astype(np.int64)
                feature, bin_, missing_left, left, right = step
                own = bins[np.arange(len(bins)), feature[before]]
                return np.where(np.where(own == 0, missing_left[before], own <= bin_[before]), left[before], right[before])

            answers = rows.sums(fresh, split, lambda f, sums: best(f, sums[:-1]), schema, len(frontier) + 1, len(frontier), True)
            found = [r for r in answers if r["feature"] != rows.width]
            following = []
            for path, i in spot.items():
                top = max((r for r in found if r["node"] == i), key=lambda r: (r["gain"], -r["feature"]))
                if not top["gain"] > 1e-12:
                    nodes[path] = (-1, 0, True, top["g"], top["h"], top["n"], 0.0)
                    continue
                nodes[path] = (top["feature"], top["bin"], top["missing_left"], top["g"], top["h"], top["n"], top["gain"])
                sides = (top["left_g"], top["left_h"], top["left_n"]), (top["g"] - top["left_g"], top["h"] - top["left_h"], top["n"] - top["left_n"])
                for side, (g, h, n) in zip("LR", sides):
                    # Known from the parent; a leaf for good at the last level, or if it cannot be parted any more.
                    nodes[path + side] = (-1, 0, True, g, h, n, 0.0)
                    if level + 1 < self.depth and h >= 2 * least_hessian * UNIT and n > 1:
                        following.append(path + side)
            # Where the rows of each open node go, those of the finished ones last.
            to = {path: i for i, path in enumerate(following)}
            facts = [(*nodes[path][:3], *[to.get(path + side, len(to)) for side in "LR"]) for path in frontier]
            step = [np.array(column) for column in zip(*facts, (0, 0, True, len(to), len(to)))]
            step[0] = np.maximum(step[0], 0)
            frontier = following
            if not frontier:
                break
        return self._tree(nodes, None)

    def _tree(self, nodes: dict[str, tuple], spot: dict[str, int] | None) -> Tree:
        """With ``spot`` the values are numbers of open nodes, else the steps of the leaves."""
        paths = list(nodes)
        facts = list(nodes.values())
        if spot is None:
            value = [self.rate * (n[3] / UNIT) / (n[4] / UNIT + self.ridge) if n[0] < 0 else 0.0 for n in facts]
        else:
            value = [spot.get(path, len(spot)) for path in paths]
        return tree_of(paths, *[[n[k] for n in facts] for k in range(3)], value, [n[5] for n in facts], [n[6] for n in facts])
