"""Embedding near-duplicates: a pigeonhole join over the subspaces of rotated vectors.

Two unit vectors have a cosine of at least t if their squared distance is at most
2 (1 - t).  Vectors are turned by a fixed rotation, which spreads them evenly over all
axes, and cut into blocks of few dimensions.  Each block gets the share of the squared
distance that its dimensions have of all; a pair within the whole budget is within its
share in some block.  So every block is range-joined alone, and the union of what the
blocks find is verified by the exact cosine.

The range join of a block: a k-d tree over its coordinates gives every vector a home
leaf; it is a guest in each lower leaf that its range reaches.  The tree has as many
levels as spare copies of the rows (none, if the vectors stand alike in all directions).
Leaves with many rows are cut into chunks, and a task gets a pair of chunks.  There, boxes of neighbouring
rows are compared first, then rows.  A pair is verified in the first block that finds
it, in the lower of its home leaves, and so exactly once.  Coordinates are rounded to
integers (the range is widened by the rounding), so all tasks agree on them.

Equal vectors are one node with a number of copies.  A task returns the links per node,
added up, and links that span its components, not pairs; so large groups of near copies
cost comparisons but no rows.

A vector travels once per block and leaf that its range reaches.  The leaves' walls come
from a bounded sample; they only steer which rows meet where, never what is found.

Defined results: vectors that are NULL, empty, zero (also if their squares vanish or
overflow) or hold NULL or non-finite components link with nothing.  Vectors of different
lengths do not link.  Rows with one id but several vectors count as several vectors.  A
NULL id is never the smallest of a component unless all are NULL.  Repeated rows link
with each other.  Other columns are ignored; an empty table gives no rows.  Texts play
no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nbgauge.llm.codes import usable
from nbgauge.llm.common import written
from nbgauge.llm.simhash import components

COSINE, BLOCKS = 0.9, 4
#: Integer coordinates of a unit vector; products of a block stay exact in single precision.
SCALE = 1024
#: Least rows of a leaf, on average; rows of a chunk, and their components; rows of a box inside a task.
LEAF_ROWS, CHUNK_ROWS, CHUNK_VALUES, BOX_ROWS = 1_024, 32_768, 2_097_152, 512
#: What the leaves' walls are learned from, what their number is judged by, and their most levels.
SAMPLE_ROWS, SAMPLE_VALUES, JUDGED_ROWS, MAX_LEVELS = 20_000, 4_000_000, 1_000, 10
#: Candidates verified at a time.
SLICE = 20_000


@dataclass(frozen=True)
class Plan:
    """Shape of the join: padded length, blocks, the range of a block, and the trees."""

    length: int
    blocks: int
    reach: int
    cosine: float
    dims: tuple
    walls: tuple

    @property
    def width(self) -> int:
        return self.length // self.blocks


def rotated(vectors: np.ndarray, length: int, seed: int = 11) -> np.ndarray:
    """Rows turned by two rounds of sign flips and Hadamard steps; sums and differences only, so each row comes out alike in any batch."""
    out = np.zeros((len(vectors), length))
    out[:, : vectors.shape[1]] = vectors
    random = np.random.Generator(np.random.PCG64(seed))
    for _ in range(2):
        out *= random.integers(0, 2, length) * 2.0 - 1.0
        step = 1
        while step < length:
            pairs = out.reshape(len(out), -1, 2, step)
            low, high = pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]
            pairs[:, :, 0], pairs[:, :, 1] = low, high
            step *= 2
        out /= np.sqrt(length)
    return out


def squared_norms(vectors: np.ndarray) -> np.ndarray:
    """Sums of squares, halving the row at each step: the same for a row in any batch."""
    width = 1 << max(0, vectors.shape[1] - 1).bit_length()
    sums = np.zeros((len(vectors), width))
    sums[:, : vectors.shape[1]] = vectors * vectors
    while sums.shape[1] > 1:
        sums = sums[:, ::2] + sums[:, 1::2]
    return sums[:, 0]


def coordinates(vectors: np.ndarray, length: int) -> np.ndarray:
    """Integer coordinates of the rotated unit vectors."""
    return np.rint(rotated(vectors / np.sqrt(squared_norms(vectors))[:, None], length) * SCALE).astype(np.int32)


def grow_tree(points: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and wall of each inner node of a k-d tree: the widest axis, cut in the middle."""
    dims, walls = np.zeros(1 << levels, np.int32), np.zeros(1 << levels, np.int32)
    runs = [points]
    for level in range(levels):
        halves = []
        for k, run in enumerate(runs):
            node = (1 << level) + k
            if len(run):
                dims[node] = int((run.max(axis=0) - run.min(axis=0)).argmax())
                walls[node] = int(np.median(run[:, dims[node]]))
            above = run[:, dims[node]] > walls[node]
            halves += [run[~above], run[above]]
        runs = halves
    return dims, walls


def leaves_of(points: np.ndarray, dims: np.ndarray, walls: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, leaf, whether it is home: the home leaf of each row, and all lower leaves within its range."""
    levels = (len(dims) - 1).bit_length()
    rows, nodes, home = np.arange(len(points)), np.ones(len(points), np.int64), np.ones(len(points), bool)
    gaps, apart = np.zeros(points.shape, np.int64), np.zeros(len(points), np.int64)
    for _ in range(levels):
        axis, wall = dims[nodes], walls[nodes]
        value = points[rows, axis].astype(np.int64)
        above = value > wall
        gap = np.where(above, value - wall, wall + 1 - value)
        across = apart - gaps[np.arange(len(rows)), axis] ** 2 + gap**2
        # From the home path only the lower side is visited.
        go = np.flatnonzero((across <= reach) & (above | ~home))
        far_gaps = gaps[go]
        far_gaps[np.arange(len(go)), axis[go]] = gap[go]
        nodes = np.concatenate([2 * nodes + above, 2 * nodes[go] + ~above[go]])
        rows, home = np.concatenate([rows, rows[go]]), np.concatenate([home, np.zeros(len(go), bool)])
        gaps, apart = np.concatenate([gaps, far_gaps]), np.concatenate([apart, across[go]])
    return rows, nodes - (1 << levels), home


def _doubles(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length together: (row numbers, matrix)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten()).astype(np.float64)
    ends = np.cumsum(sizes)
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((rows, flat[(ends[rows] - size)[:, None] + np.arange(size)]))
    return out


def fewest_copies(points: np.ndarray, dims: np.ndarray, walls: np.ndarray, reach: int, rows: int, chunk_rows: int) -> int:
    """Levels of a tree at which a row meets the others in the fewest cells.

    More levels make smaller leaves, of which a row reaches more.  Vectors in clusters
    reach few; where all directions are alike, chunks without any leaf are better.
    """
    best, chosen = np.inf, 0
    for levels in range((len(dims) - 1).bit_length() + 1):
        reached = len(leaves_of(points, dims[: 1 << levels], walls[: 1 << levels], reach)[0]) / len(points)
        if reached > 4 * best:
            break
        copies = reached * max(1, -(-int(rows * reached / (1 << levels)) // chunk_rows))
        if copies < best:
            best, chosen = copies, levels
    return chosen


def make_plan(nodes: DataFrame, cosine: float, blocks: int, leaf_rows: int, chunk_rows: int) -> Plan | None:
    """Trees from a bounded sample, those nodes with the smallest hashes."""
    facts = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("length")).first()
    if not facts["n"]:
        return None
    length = 1 << (facts["length"] - 1).bit_length()
    blocks = min(1 << (blocks.bit_length() - 1), length)
    sample = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // length))
    levels = max(0, min(MAX_LEVELS, -(-facts["n"] // leaf_rows) - 1)).bit_length()
    levels = min(levels, MAX_LEVELS, max(0, (sample // 16).bit_length() - 1))
    taken = nodes.select("embedding").orderBy(F.xxhash64("node")).limit(sample).toArrow()["embedding"]
    points = np.concatenate([coordinates(x, length) for _, x in _doubles(taken)])
    width = length // blocks
    # Rounding moves the difference of two blocks by at most the root of their dimensions.
    reach = SCALE * np.sqrt(max(0.0, 2 * (1 - cosine) + 1e-9) * width / length) + np.sqrt(width) + 1e-6
    reach = int(reach * reach)
    trees = [grow_tree(points[:, b * width : (b + 1) * width], levels) for b in range(blocks)]
    judged = points[:: max(1, len(points) // JUDGED_ROWS)]
    deep = [fewest_copies(judged[:, b * width : (b + 1) * width], *trees[b], reach, facts["n"], chunk_rows) for b in range(blocks)]
    # The same number for all blocks, as the rotation makes them alike.
    kept = 1 << int(np.median(deep))
    return Plan(length, blocks, reach, cosine, tuple(t[0][:kept] for t in trees), tuple(t[1][:kept] for t in trees))


def leaf_sizes(nodes: DataFrame, plan: Plan) -> np.ndarray:
    """Rows of each leaf of each block, guests included; their number is bounded by the plan."""
    leaves = len(plan.dims[0])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(plan.blocks * leaves, np.int64)
        for batch in batches:
            for _, vectors in _doubles(batch.column(0)):
                points = coordinates(vectors, plan.length)
                for b in range(plan.blocks):
                    _, found, _ = leaves_of(points[:, b * plan.width : (b + 1) * plan.width], plan.dims[b], plan.walls[b], plan.reach)
                    sizes[b * leaves : (b + 1) * leaves] += np.bincount(found, minlength=leaves)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sizes))), pa.array(sizes)], names=["leaf", "n"])

    sizes = np.zeros(plan.blocks * leaves, np.int64)
    for row in nodes.select("embedding").mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        sizes[row["leaf"]] = row["n"]
    return sizes.reshape(plan.blocks, leaves)


def cells(nodes: DataFrame, plan: Plan, chunks: np.ndarray) -> DataFrame:
    """All nodes in all cells (block, leaf, low, high) where they meet others."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            for which, vectors in _doubles(batch.column(2)):
                points = coordinates(vectors, plan.length)
                for b in range(plan.blocks):
                    rows, leaf, home = leaves_of(points[:, b * plan.width : (b + 1) * plan.width], plan.dims[b], plan.walls[b], plan.reach)
                    rows = which[rows]
                    # A fixed mix of the node's number deals the rows of a leaf to its chunks.
                    mixed = (number[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                    own = (mixed % chunks[b][leaf].astype(np.uint64)).astype(np.int32)
                    columns = [pa.array(np.full(len(rows), b, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(own), pa.array(chunks[b][leaf].astype(np.int32)), pa.array(home)]
                    yield pa.RecordBatch.from_arrays([*columns, *[batch.column(i).take(pa.array(rows)) for i in range(3)]], names=names)

    names = ["block", "leaf", "chunk", "chunks", "home", "node", "copies", "embedding"]
    vector = nodes.schema["embedding"].dataType.simpleString()
    placed = nodes.select("node", "copies", "embedding").mapInArrow(
        place, f"block int, leaf int, chunk int, chunks int, home boolean, node long, copies long, embedding {vector}"
    )
    met = placed.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    return met.select("block", "leaf", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), *names[2:3], *names[4:])


def _boxes(points: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Runs of neighbouring rows."""
    out, open_ = [], [rows]
    while open_:
        run = open_.pop()
        if len(run) <= BOX_ROWS:
            out.append(run)
            continue
        own = points[run]
        axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
        order = np.argpartition(own[:, axis], len(run) // 2)
        open_ += [run[order[: len(run) // 2]], run[order[len(run) // 2 :]]]
    return [run for run in out if len(run)]


class _Spanning:
    """Links that connect what is not connected yet."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.a: list[int] = []
        self.b: list[int] = []

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        while True:
            new = np.flatnonzero(self.label[left] != self.label[right])
            if not len(new):
                return
            left, right = left[new], right[new]
            low, high = np.minimum(self.label[left], self.label[right]), np.maximum(self.label[left], self.label[right])
            # Every label that has smaller neighbours takes one of them, by one link.
            tops, first = np.unique(high, return_index=True)
            self.a += left[first].tolist()
            self.b += right[first].tolist()
            turned = np.arange(len(self.label))
            turned[tops] = low[first]
            while not np.array_equal(turned, turned[turned]):
                turned = turned[turned]
            self.label = turned[self.label]


def near_pairs(points: np.ndarray, left: np.ndarray, right: np.ndarray, reach: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the range in one block, box by box."""
    ones = _boxes(points, left)
    others = ones if same else _boxes(points, right)
    if not ones or not others:
        return

    def sides(rows, left):
        """One product of two sides is the squared distance: whole numbers, exact in single precision."""
        p = points[rows].astype(np.float32)
        squares, ones_ = (p * p).sum(axis=1, keepdims=True), np.ones((len(p), 1), np.float32)
        return np.hstack([-2 * p, squares, ones_] if left else [p, ones_, squares])

    kept = [np.ascontiguousarray(sides(rows, False).T) for rows in others]
    lows, highs = (np.stack([f(points[rows], axis=0) for rows in others]).astype(np.int64) for f in (np.min, np.max))
    for i, rows in enumerate(ones):
        p = sides(rows, True)
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        gap = np.maximum(0, np.maximum(lows - high, low - highs))
        for j in np.flatnonzero((gap * gap).sum(axis=1) <= reach).tolist():
            if same and j < i:
                continue
            x, y = np.divmod(np.flatnonzero(p @ kept[j] <= reach), len(others[j]))
            if same and i == j:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield rows[x], others[j][y]


def join_cell(block: int, same: bool, rows: pa.Table, plan: Plan) -> pa.Table:
    """Links per node, added up (b is NULL), and spanning links, of the pairs that this cell is the first to find."""
    n = len(rows)
    points, vectors, norms, sizes = np.zeros((n, plan.length), np.int32), np.zeros((n, plan.length)), np.zeros(n), np.zeros(n, np.int64)
    for which, values in _doubles(rows["embedding"]):
        points[which], norms[which], sizes[which] = coordinates(values, plan.length), np.sqrt(squared_norms(values)), values.shape[1]
        vectors[which, : values.shape[1]] = values
    number, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
    home, chunk = rows["home"].to_numpy(zero_copy_only=False).astype(bool), rows["chunk"].to_numpy()
    own = points[:, block * plan.width : (block + 1) * plan.width]
    everyone = np.arange(n)
    left, right = (everyone, everyone) if same else (everyone[chunk == chunk.min()], everyone[chunk == chunk.max()])
    if not same and chunk.min() == chunk.max():
        left = right = everyone[:0]
    links, spanning = np.zeros(n, np.int64), _Spanning(n)
    for all_x, all_y in near_pairs(own, left, right, plan.reach, same):
        for at in range(0, len(all_x), SLICE):
            x, y = all_x[at : at + SLICE], all_y[at : at + SLICE]
            fit = (home[x] | home[y]) & (sizes[x] == sizes[y])
            x, y = x[fit], y[fit]
            if block:
                before = points[x, : block * plan.width] - points[y, : block * plan.width]
                apart = (before * before).reshape(len(x), block, plan.width).sum(axis=2)
                new = (apart > plan.reach).all(axis=1)
                x, y = x[new], y[new]
            cosine = np.einsum("ij,ij->i", vectors[x], vectors[y]) / (norms[x] * norms[y])
            x, y = x[cosine >= plan.cosine], y[cosine >= plan.cosine]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            spanning.add(x, y)
    some = np.flatnonzero(links)
    a, b = number[np.array(spanning.a, np.int64)], number[np.array(spanning.b, np.int64)]
    return pa.table(
        {
            "a": np.concatenate([number[some], a]),
            "b": pa.array(np.concatenate([number[some], b]), mask=np.arange(len(some) + len(a)) < len(some)),
            "n": np.concatenate([links[some], np.zeros(len(a), np.int64)]),
        }
    )


def node_links(nodes: DataFrame, plan: Plan, chunk_rows: int) -> DataFrame:
    chunks = np.maximum(1, -(-leaf_sizes(nodes, plan) // chunk_rows))

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        block, _, low, high = (k.as_py() for k in key)
        return join_cell(block, low == high, rows, plan)

    return cells(nodes, plan, chunks).groupBy("block", "leaf", "low", "high").applyInArrow(join, "a long, b long, n long")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, leaf_rows: int = LEAF_ROWS, chunk_rows: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per vector."""
    squares = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda total, x: total + x * x)
    linkable = usable() & (squares > 0) & (squares < float("inf"))
    marked = embeddings.select("vec_id", F.when(linkable, F.col("embedding")).alias("embedding"))
    vectors, rest = marked.where("embedding IS NOT NULL"), marked.where("embedding IS NULL")
    nodes = vectors.groupBy("embedding").agg(F.min("vec_id").alias("smallest"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    length = nodes.agg(F.max(F.size("embedding"))).first()[0] or 1
    chunk_rows = chunk_rows or max(1, min(CHUNK_ROWS, CHUNK_VALUES // length))
    plan = make_plan(nodes, cosine, blocks, leaf_rows, chunk_rows)
    if plan is None:
        return alone.withColumn("kept", F.lit(True))
    found = written(node_links(nodes, plan, chunk_rows), "vector-links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    joined = components(found.where("b IS NOT NULL").select("a", "b"))
    placed = nodes.join(counts, "node", "left").join(joined, "node", "left").select(
        "embedding", "smallest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")
    )
    classes = placed.groupBy("component").agg(F.min("smallest").alias("component_id"))
    facts = placed.join(classes, "component").select("embedding", "n_links", "component_id")
    linked = vectors.join(facts, "embedding").select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
