"""Shapley values of tree ensembles, row by row.

The value of a set of known features is the mean over the leaves that a row may reach,
an unknown feature's split counting both sides by their rows.  A leaf's part in the
value of feature i is then, with z the share of rows that a feature's splits let through
and o whether the row passes them,

    value * (o_i - z_i) * integral over t in (0, 1) of the product over j != i of z_j (1 - t) + o_j t,

as the weights of Shapley's formula are beta integrals.  The product is a polynomial, so
Gauss-Legendre points give the integral exactly.  Trees are walked once for a batch of
rows; a model is shipped only if its nodes are few enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nbgauge.operators.trees import Tree, TreeModel, bin_numbers, distinct_rows

#: Rows walked together.
ROWS = 2_000


def mean_value(tree: Tree) -> float:
    """Mean over the rows the tree was grown on."""
    leaf = tree.feature < 0
    return float((tree.value * tree.cover)[leaf].sum() / tree.cover[leaf].sum()) if tree.cover[leaf].sum() else float(tree.value[leaf].mean())


def tree_attributions(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """rows x features."""
    n, width = bins.shape
    out = np.zeros((n, width))
    points, weights = np.polynomial.legendre.leggauss(max(1, -(-min(tree.depth, width) // 2)))
    t, weights = (points + 1) / 2, weights / 2
    # On the way to a node: z and o of each feature asked so far, and the product of their factors.
    open_: list[tuple[int, dict, np.ndarray]] = [(0, {}, np.ones((n, len(t))))]
    factor = lambda z, o: z * (1 - t)[None] + o[:, None] * t[None]
    while open_:
        node, known, product = open_.pop()
        f = int(tree.feature[node])
        if f < 0:
            for g, (z, o) in known.items():
                # Factors are above 0 between the ends, as every side has rows.
                part = (product / factor(z, o)) @ weights
                out[:, g] += tree.value[node] * (o - z) * part
            continue
        b = bins[:, f]
        goes_left = np.where(b == 0, tree.missing_left[node], b <= tree.bin[node])
        z, o = known.get(f, (1.0, np.ones(n)))
        before = product / factor(z, o) if f in known else product
        for child, passes in ((int(tree.left[node]), goes_left), (int(tree.right[node]), ~goes_left)):
            share = tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.0
            if not share:
                continue
            now = (z * share, o * passes)
            open_.append((child, known | {f: now}, before * factor(*now)))
    return out


def attributions(model: TreeModel, df: DataFrame, column: str = "attributions", base: str = "base") -> DataFrame:
    """Add ``base``, the model's mean, and ``attributions``, an array in the order of the model's features; together the row's margin (or share)."""
    trees, walls = model.trees(), model.walls
    divide = model.n_trees if model.link == "share" else 1

    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = []
            for at in range(0, len(batch), ROWS):
                values = [x.to_numpy(zero_copy_only=False) for x in batch.slice(at, ROWS).flatten()]
                bins = np.stack([bin_numbers(v, w) for v, w in zip(values, walls)], axis=1)
                first, kind = distinct_rows(bins)
                some = bins[first]
                total = np.zeros(some.shape)
                for tree in trees:
                    total += tree_attributions(tree, some)
                parts.append((total / divide)[kind])
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * len(walls), pa.int32()), pa.array(flat))

    compute.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    inputs = F.struct(*[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(model.features)])
    mean = sum(mean_value(tree) for tree in trees) / divide
    return df.withColumns({base: F.lit(mean), column: F.arrow_udf(compute, "array<double>")(inputs)})


def mean_attributions(model: TreeModel, df: DataFrame) -> DataFrame:
    """feature, mean_attribution, mean_size: direction and size of each feature's part over all rows."""
    named = attributions(model, df.select(*[F.col(f"`{c}`") for c in model.features]), "_a", "_b").select(
        F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in model.features]).alias("feature"), F.col("_a").alias("value"))).alias("x")
    )
    return named.groupBy("x.feature").agg(F.avg("x.value").alias("mean_attribution"), F.avg(F.abs("x.value")).alias("mean_size"))
