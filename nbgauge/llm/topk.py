"""Exact top-k by histogram selection.

Every query scores every vector, pass after pass, block by block.  A pass counts,
for each query, how many scores fall into each of 256 equal parts of the range
that still holds its k-th best; the counts of all tasks are added up, the part
with the k-th best becomes the next range, and after a few passes that range is
one integer: the exact k-th score.  A last pass takes all scores above it, and of
the ties at it those with the smallest ids.

A task only counts down to its own k-th best (the global one cannot lie below),
so it returns at most k parts per query however many rows it has scored.

Defined results: vectors that are NULL or hold NULL, NaN or infinite components
and rows without an id take no part; nor do pairs of different length.  A query
id that repeats asks once, with the smallest of its vectors; candidates that
repeat are all ranked, but none with the query's own id.  Queries with fewer than
k candidates return all; scores beyond a long are cut to its limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nbgauge.session import cut_lineage

PARTS = 256
_LONG = np.iinfo(np.int64)


def quantised(table: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and vector: floor(scale x component) as double, of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable)
    return kept.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(vector, lambda x: F.rint(F.lit(0.0)) + _floor(x * scale)).alias("vector")
    )


def _floor(x):
    """Floor as a double: F.floor gives a long, which large components overflow."""
    down = F.rint(x)
    return F.when(down > x, down - 1).otherwise(down)


class QueryBlock:
    """Some queries (a bounded number) and, per query, the range their k-th best lies in."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], k: int):
        self.ids, self.k = ids, k
        self.groups = {}
        for length in sorted({len(v) for v in vectors}):
            rows = [i for i, v in enumerate(vectors) if len(v) == length]
            self.groups[length] = (np.array(rows), np.array([vectors[i] for i in rows]).reshape(len(rows), length))

    def scores(self, ids: np.ndarray, vectors: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of the queries, ids of the candidates, scores (queries x candidates), and which pairs count."""
        lengths = np.array([len(v) for v in vectors])
        for length, (rows, matrix) in self.groups.items():
            at = np.flatnonzero(lengths == length)
            if not len(at):
                continue
            other = np.array([vectors[i] for i in at]).reshape(len(at), length)
            yield rows, ids[at], products(matrix, other), self.ids[rows][:, None] != ids[at][None, :]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; floats are exact below 2^53, beyond Python's integers are used."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(a) @ exact(b).T, _LONG.min, _LONG.max).astype(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            column = part.column(1)
            values = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            yield part.column(0).to_numpy(zero_copy_only=False), np.split(values, ends[:-1]) if len(ends) else []


def histogram_pass(vectors: DataFrame, block: QueryBlock, low: np.ndarray, width: np.ndarray, span: np.ndarray, need: np.ndarray, rows: int) -> DataFrame:
    """query, part, n: for each query how many scores lie in each part of its range, from the top to the task's own ``need``."""
    n_queries = len(block.ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((n_queries, PARTS), dtype=np.int64)
        for ids, found in _batches(batches, rows):
            for places, _, scores, valid in block.scores(ids, found):
                start, step = low[places][:, None], width[places][:, None]
                # ``span`` ends the range: rounded up, 256 parts may reach beyond it.
                inside = valid & (scores >= start) & ((scores - start).view(np.uint64) < span[places][:, None])
                q, c = np.nonzero(inside)
                part = ((scores[q, c] - start[q, 0]).view(np.uint64) // step[q, 0].astype(np.uint64)).astype(np.int64)
                counts += np.bincount(places[q] * PARTS + part, minlength=n_queries * PARTS).reshape(n_queries, PARTS)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, p = np.nonzero((counts > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(counts[q, p])], names=["query", "part", "n"])

    counted = vectors.mapInArrow(count, "query int, part int, n long")
    return counted.groupBy("query", "part").agg(F.sum("n").alias("n"))


def select_block(vectors: DataFrame, block: QueryBlock, rows: int) -> DataFrame:
    """Candidates of one block of queries: all above the k-th score and enough of its ties."""
    n, k = len(block.ids), block.k
    low = np.full(n, _LONG.min, dtype=np.int64)
    width = np.full(n, 1 << 56, dtype=np.int64)
    span = np.full(n, (1 << 64) - 1, dtype=np.uint64)
    need = np.full(n, k, dtype=np.int64)
    short = np.zeros(n, dtype=bool)
    limits = score_limits(vectors, block)
    if limits is not None:
        low[:] = -limits
        width[:] = max(1, -(-(2 * limits + 1) // PARTS))
    while True:
        # At most k counts per query and task come together, and 256 per query here.
        counts = np.zeros((n, PARTS), dtype=np.int64)
        table = histogram_pass(vectors, block, low, width, span, need, rows).toArrow()
        np.add.at(counts, (table["query"].to_numpy(), table["part"].to_numpy()), table["n"].to_numpy())
        down = np.cumsum(counts[:, ::-1], axis=1)
        reached = (down >= need[:, None]).argmax(axis=1)
        # Fewer candidates than k: take them all.
        short |= down[:, -1] < need
        part = PARTS - 1 - reached
        above = np.where(reached > 0, down[np.arange(n), np.maximum(reached - 1, 0)], 0)
        low = np.where(short, _LONG.min, low + part * width)
        need = np.where(short, need, need - above)
        if (width == 1).all():
            break
        # A query that takes all of its candidates counts no more.
        span = np.where(short, 0, width.astype(np.uint64)).astype(np.uint64)
        width = np.maximum(1, -(-width // PARTS))
    threshold = low

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple[int, int]]] = {}
        for ids, found in _batches(batches, rows):
            for places, candidates, scores, valid in block.scores(ids, found):
                q, c = np.nonzero(valid & (scores >= threshold[places][:, None]))
                # The k best of each query in this batch: ties may be many.
                order = np.lexsort((candidates[c], -scores[q, c], q))
                q, c = q[order], c[order]
                first = np.flatnonzero(np.diff(q, prepend=-1))
                nth = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q)))
                q, c = q[nth < k], c[nth < k]
                for query, vec, score in zip(places[q].tolist(), candidates[c].tolist(), scores[q, c].tolist()):
                    mine = kept.setdefault(query, [])
                    mine.append((-score, vec))
                    if len(mine) > 64 + 2 * k:
                        mine.sort()
                        del mine[k:]
        out = [(query, vec, -score) for query, mine in kept.items() for score, vec in sorted(mine)[:k]]
        columns = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.ids[np.array(columns[0], dtype=np.int64)]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
            names=["query_id", "vec_id", "score"],
        )

    return vectors.mapInArrow(take, "query_id long, vec_id long, score long")


def score_limits(vectors: DataFrame, block: QueryBlock) -> int | None:
    """Bound on the size of any score: longest query times longest vector (Cauchy-Schwarz); None beyond 2^53."""
    longest = vectors.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()["m"]
    mine = max((float((m * m).sum(axis=1).max()) for _, m in block.groups.values() if m.size), default=0.0)
    bound = (mine * (longest or 0.0)) ** 0.5 + 1
    return int(bound) + 1 if bound < 2.0**53 else None


def top_k(table: DataFrame, k: int = 5, every: int = 50, query_block: int = 2048, rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every query, ties to smaller ids.

    Queries are the rows whose id is divisible by ``every``.  ``query_block``
    bounds what is shipped to the tasks at a time, ``rows`` how many vectors they
    score at once.
    """
    vectors = cut_lineage(quantised(table))
    queries = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n = queries.count()
    blocks = max(1, -(-n // query_block))
    placed = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    parts = []
    for number in range(blocks):
        # About ``query_block`` rows.
        mine = placed.where(F.col("block") == number).orderBy("vec_id").collect()
        block = QueryBlock(np.array([r["vec_id"] for r in mine], dtype=np.int64), [np.array(r["vector"], dtype=float) for r in mine], k)
        parts.append(select_block(vectors, block, rows))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
