"""Tree ensembles over binned features: bins, the model, and scoring.

Learners (``boosting``, ``forest``) see a row as one byte per feature: 0 for a missing
value, else the number of the first wall that the value does not exceed.  A model keeps
the walls themselves, so it scores raw values, NULL and NaN included.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nbgauge.session import cut_lineage

#: Bins of a feature besides the one of missing values.
MAX_BINS = 254
#: Entries that a task's summary of a feature keeps.
SUMMARY = 2_048
#: Nodes that are shipped to the tasks; larger models are joined, level by level.
SHIPPED_NODES = 2_000_000

NODES = (
    "tree int, path string, feature int, bin int, wall double, missing_left boolean, value double, cover double, gain double"
)


def _thinned(values: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``size`` of the distinct values, each with the weight up to it since the one before."""
    kept, at = np.unique(values, return_inverse=True)
    total = np.bincount(at, weights=weights, minlength=len(kept))
    if len(kept) <= size:
        return kept, total
    upto = np.cumsum(total)
    last = np.unique(np.append(np.searchsorted(upto, upto[-1] * np.arange(1, size) / size), len(kept) - 1))
    return kept[last], np.diff(upto[last], prepend=0.0)


def walls_of(df: DataFrame, features: Sequence[str], weight: str | None = None, bins: int = MAX_BINS) -> list[np.ndarray]:
    """Ascending walls of each feature, equally far apart in weight.

    Every task thins the weighted values of a feature to a summary of bounded size;
    the summaries of a feature are merged in one group.  Features with few values get
    a wall at each but the largest, so nothing is lost on them.
    """
    columns = [F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    weights = F.col(weight).cast("double") if weight else F.lit(1.0)

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0), np.zeros(0))] * len(features)
        for batch in batches:
            w = batch.column(len(features)).to_numpy(zero_copy_only=False)
            for i in range(len(features)):
                v = batch.column(i).to_numpy(zero_copy_only=False)
                there = ~np.isnan(v) & (w > 0)
                held[i] = _thinned(np.concatenate([held[i][0], v[there]]), np.concatenate([held[i][1], w[there]]), SUMMARY)
        for i, (v, w) in enumerate(held):
            if len(v):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v), pa.array(w)], names=["feature", "value", "weight"])

    def merge(table: pa.Table) -> pa.Table:
        kept, total = np.unique(table["value"].to_numpy(), return_inverse=True)
        total = np.bincount(total, weights=table["weight"].to_numpy(), minlength=len(kept))
        kept, _ = (kept, total) if len(kept) <= bins else _thinned(kept, total, bins)
        return pa.table({"feature": pa.array([table["feature"][0].as_py()], pa.int32()), "walls": pa.array([kept[:-1].tolist()], pa.list_(pa.float64()))})

    parts = df.select(*columns, weights.alias("weight")).mapInArrow(summarize, "feature int, value double, weight double")
    found = {r["feature"]: r["walls"] for r in parts.groupBy("feature").applyInArrow(merge, "feature int, walls array<double>").collect()}
    return [np.array(found.get(i, []), dtype=float) for i in range(len(features))]


def bin_numbers(values: np.ndarray, walls: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(values), 0, np.searchsorted(walls, values, side="left") + 1).astype(np.uint8)


def binned(df: DataFrame, features: Sequence[str], walls: list[np.ndarray], *others: str) -> DataFrame:
    """``others`` and ``bins``, one byte per feature. Map-only."""
    kinds = ", ".join(f"{c} {kind}" for c, kind in df.select(*others).dtypes)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.stack([bin_numbers(batch.column(i).to_numpy(zero_copy_only=False), w) for i, w in enumerate(walls)], axis=1)
            rows = pa.array([row.tobytes() for row in table], pa.binary())
            yield pa.RecordBatch.from_arrays([rows, *batch.columns[len(walls) :]], names=["bins", *others])

    columns = [F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    return df.select(*columns, *others).mapInArrow(compute, f"bins binary, {kinds}" if kinds else "bins binary")


def bytes_table(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a binary column of equal lengths as a matrix of bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def distinct_rows(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of bytes of each kind, by place, and the kind of every row.  Rows of one kind take the same way through a tree."""
    n, width = table.shape
    if not n or not width:
        return np.arange(min(n, 1)), np.zeros(n, np.int64)
    if width <= 8:
        keys = np.zeros((n, 8), np.uint8)
        keys[:, :width] = table
        keys = keys.view(np.uint64).ravel()
    else:
        keys = np.ascontiguousarray(table).view(np.dtype((np.void, width))).ravel()
    _, first, kind = np.unique(keys, return_index=True, return_inverse=True)
    return first, kind.reshape(-1)


@dataclass
class Tree:
    """Arrays over the nodes, the root first; a leaf is its own child."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @property
    def depth(self) -> int:
        """Longest way to a leaf."""
        level, deepest = np.array([0]), 0
        while True:
            level = level[self.feature[level] >= 0]
            if not len(level):
                return deepest
            level, deepest = np.concatenate([self.left[level], self.right[level]]), deepest + 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows) and self.feature[0] >= 0:
            node = at[rows]
            b = bins[rows, self.feature[node]]
            goes_left = np.where(b == 0, self.missing_left[node], b <= self.bin[node])
            at[rows] = np.where(goes_left, self.left[node], self.right[node])
            rows = rows[self.feature[at[rows]] >= 0]
        return at

    def rows(self, number: int, walls: list[np.ndarray]) -> list[tuple]:
        """NODES of the tree: a path of L and R leads to each node."""
        out, open_ = [], [(0, "")]
        while open_:
            node, path = open_.pop()
            f = int(self.feature[node])
            wall = None
            if f >= 0:
                b = int(self.bin[node])
                # A wall of minus infinity parts missing values from all others.
                wall = float(walls[f][b - 1]) if b else float("-inf")
                open_ += [(int(self.left[node]), path + "L"), (int(self.right[node]), path + "R")]
            out.append((
                number, path, f, int(self.bin[node]), wall, bool(self.missing_left[node]), float(self.value[node]), float(self.cover[node]), float(self.gain[node]),
            ))
        return out


def single_leaf(value: float, cover: float = 1.0) -> Tree:
    zero = np.zeros(1, np.int64)
    return Tree(zero - 1, zero, zero > 0, zero, zero, np.array([value]), np.array([cover]), np.zeros(1))


def tree_of(paths: Sequence[str], feature, bin_, missing_left, value, cover, gain) -> Tree:
    """Tree from its nodes by path, in any order."""
    order = sorted(range(len(paths)), key=lambda i: (len(paths[i]), paths[i]))
    place = {paths[i]: k for k, i in enumerate(order)}
    pick = lambda x, kind: np.asarray(x)[order].astype(kind)
    own = np.arange(len(order))
    left = np.array([place.get(paths[i] + "L", k) for k, i in enumerate(order)], np.int64)
    right = np.array([place.get(paths[i] + "R", k) for k, i in enumerate(order)], np.int64)
    feature = pick(feature, np.int64)
    return Tree(feature, pick(bin_, np.int64), pick(missing_left, bool), np.where(feature < 0, own, left), np.where(feature < 0, own, right), pick(value, float), pick(cover, float), pick(gain, float))


@dataclass
class TreeModel:
    """Trees whose values are added up (``margin``, through the logistic curve) or averaged (``share``)."""

    features: list[str]
    walls: list[np.ndarray]
    link: str
    nodes: DataFrame
    n_nodes: int
    info: dict = field(default_factory=dict)

    @classmethod
    def of(cls, spark: SparkSession, features: Sequence[str], walls: list[np.ndarray], link: str, trees: Sequence[Tree], **info) -> TreeModel:
        rows = [row for number, tree in enumerate(trees) for row in tree.rows(number, walls)]
        return cls(list(features), walls, link, spark.createDataFrame(rows, NODES), len(rows), {"trees": len(trees), **info})

    def trees(self) -> list[Tree]:
        """The trees on the driver; only models small enough to be shipped."""
        if self.n_nodes > SHIPPED_NODES:
            raise ValueError(f"{self.n_nodes} nodes are too many to be shipped")
        table = self.nodes.orderBy("tree", "path").toArrow()
        number = table["tree"].to_numpy()
        cuts = np.flatnonzero(np.diff(number, prepend=-1)) if len(number) else np.zeros(0, int)
        columns = {c: table[c].to_pylist() for c in ("path", "feature", "bin", "missing_left", "value", "cover", "gain")}
        return [tree_of(*[columns[c][a:b] for c in columns]) for a, b in zip(cuts, [*cuts[1:], len(number)])]

    @property
    def n_trees(self) -> int:
        return self.info.get("trees") or self.nodes.agg(F.count_distinct("tree")).first()[0]

    def with_margin(self, df: DataFrame, column: str = "margin") -> DataFrame:
        """Add the sum of the trees' values; for ``share`` their mean."""
        divide = self.n_trees if self.link == "share" else 1
        if self.n_nodes > SHIPPED_NODES:
            return self._joined(df, column, divide)
        trees, walls = self.trees(), self.walls

        def margins(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                values = [x.to_numpy(zero_copy_only=False) for x in batch.flatten()]
                bins = np.stack([bin_numbers(v, w) for v, w in zip(values, walls)], axis=1)
                first, kind = distinct_rows(bins)
                some = bins[first]
                total = np.zeros(len(some))
                for tree in trees:
                    total += tree.value[tree.leaves(some)]
                yield pa.array((total / divide)[kind])

        margins.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        inputs = F.struct(*[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(self.features)])
        return df.withColumn(column, F.arrow_udf(margins, "double")(inputs))

    def _joined(self, df: DataFrame, column: str, divide: int) -> DataFrame:
        """Every row steps down all trees at once, by a join with the node table per level."""
        rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
        values = F.array(*[F.col(f"`{c}`").cast("double") for c in self.features]).alias("values")
        every = F.explode(F.sequence(F.lit(0), F.lit(self.n_trees - 1))).alias("tree")
        walk = rows.select("_row", values, every).withColumn("path", F.lit(""))
        nodes = self.nodes.select("tree", "path", "feature", "wall", "missing_left", "value")
        done = None
        while walk.head(1):
            at = walk.join(nodes, ["tree", "path"])
            x = F.get("values", F.col("feature"))
            left = F.when(x.isNull() | F.isnan(x), F.col("missing_left")).otherwise(x <= F.col("wall"))
            ended = at.where("feature < 0").groupBy("_row").agg(F.sum("value").alias("part"))
            ended = cut_lineage(ended)
            done = ended if done is None else done.union(ended)
            walk = cut_lineage(at.where("feature >= 0").select("_row", "values", "tree", F.concat("path", F.when(left, F.lit("L")).otherwise(F.lit("R"))).alias("path")))
        if done is None:
            return df.withColumn(column, F.lit(0.0))
        total = done.groupBy("_row").agg((F.sum("part") / divide).alias(column))
        return rows.join(total, "_row").drop("_row")

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` (0/1) and ``score``, the probability of class 1."""
        scored = self.with_margin(df, "_margin")
        score = F.col("_margin") if self.link == "share" else 1 / (1 + F.exp(-F.col("_margin")))
        scored = scored.withColumn("score", score)
        return scored.select(*df.columns, (F.col("score") > 0.5).cast("int").alias("prediction"), "score")

    def importance(self) -> dict[str, float]:
        """Share of each feature in the gain of all splits."""
        gains = {r["feature"]: r["gain"] for r in self.nodes.where("feature >= 0").groupBy("feature").agg(F.sum("gain").alias("gain")).collect()}
        total = sum(gains.values()) or 1.0
        return {name: gains.get(i, 0.0) / total for i, name in enumerate(self.features)}

    def save(self, path: str) -> None:
        spark = self.nodes.sparkSession
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        about = {"features": self.features, "walls": [w.tolist() for w in self.walls], "link": self.link, "n_nodes": self.n_nodes, "info": self.info}
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").json(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        about = json.loads(spark.read.schema("about string").json(f"{path}/about").first()["about"])
        walls = [np.array(w, dtype=float) for w in about["walls"]]
        return cls(about["features"], walls, about["link"], spark.read.schema(NODES).parquet(f"{path}/nodes"), about["n_nodes"], about["info"])
