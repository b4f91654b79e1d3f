"""Quality of documents from their lines: a linear-chain conditional random field.

Every line is good or bad.  Its features are its own (shares of kinds of
characters, repeated words, length, ...) and those of the lines before and
after.  Forward-backward gives the marginal of each line; their mean by length is
the document's, and a fitted logistic curve turns it into the score.

Labels are known for documents only, so the lines' labels are learned in
rounds: all lines of a bad document start as bad, then those which the fitted
field calls good become good (the worst line stays bad), and it is fitted again.

Defined results: NULL and empty texts are one empty line; with no length to
weigh by, its plain marginal counts.  With labels of one kind only the score is
that kind's share.  Long texts are scored whole, line by line; one long line is one line.  Repeated rows are scored each; a labelled id that repeats
in ``documents`` or in ``labels`` teaches once (any bad label makes it bad).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nbgauge.llm.common import HELD_OUT_FOLD, fold, held_out, smallest_hashes, text_function

N_OWN = 11
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 1
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
_CLASS[[ord(c) for c in "0123456789"]] = 3
_CLASS[[ord(c) for c in " \t\v\f\r"]] = 4
_CLASS[[ord(c) for c in ".,;:'\"?-()"]] = 5
_CLASS[ord("!")] = 6
_CLASS[ord("|")] = 7
_CLASS[[c for c in range(33, 127) if _CLASS[c] == 0]] = 8
_CLASS[128:] = 1
SMALL, CAPITAL, DIGIT, SPACE, MARK, SHOUT, BAR, SYMBOL = range(1, 9)


def line_features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines, their lengths in bytes, and the number of lines of each text."""
    raw = [(t or "").encode() for t in texts]
    joined = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    newline = joined == 10
    line = np.cumsum(newline) - newline
    n = int(line[-1]) + 1 if len(joined) else 0
    kinds = _CLASS[joined]
    lengths = np.bincount(line, minlength=n) - 1
    count = {k: np.bincount(line[kinds == k], minlength=n) for k in range(1, 9)}
    letters = count[SMALL] + count[CAPITAL]
    total = np.maximum(lengths, 1)

    blank = newline | (kinds == SPACE)
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    words = np.zeros(n)
    repeated = np.zeros(n)
    if len(starts):
        # A word's signature: its bytes weighted by their place in it.
        word = np.cumsum(np.bincount(starts, minlength=len(joined))) - 1
        inside = np.flatnonzero(~blank)
        place = inside - starts[word[inside]] + 1
        signature = np.bincount(word[inside], weights=joined[inside] * np.sqrt(place), minlength=len(starts))
        of_line = line[starts]
        words = np.bincount(of_line, minlength=n).astype(float)
        same = (signature[1:] == signature[:-1]) & (of_line[1:] == of_line[:-1])
        repeated = np.bincount(of_line[1:][same], minlength=n)
    ends = np.flatnonzero(newline)
    last = np.where(lengths > 0, joined[np.maximum(ends - 1, 0)], 0)
    features = np.stack(
        [
            np.ones(n),
            count[CAPITAL] / np.maximum(letters, 1),
            count[SYMBOL] / total,
            count[DIGIT] / total,
            5 * count[SHOUT] / total,
            5 * count[BAR] / total,
            repeated / np.maximum(words, 1),
            count[MARK] / total,
            np.log1p(lengths) / 10,
            np.isin(last, [46, 63]).astype(float),
            np.minimum(lengths / np.maximum(words, 1) / 10, 3),
        ],
        axis=1,
    )
    sizes = np.array([r.count(b"\n") + 1 for r in raw], dtype=np.int64)
    return features, lengths, sizes


def with_neighbours(own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Features of the line, the one before and the one after (zero beyond a text's ends)."""
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(int)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first] = 0
    after[first + sizes - 1] = 0
    return np.concatenate([own, before, after], axis=1)


def forward_backward(bad: np.ndarray, change: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(bad) of each line, expected numbers of label pairs (2 x 2, summed over texts weighted 1/lines), log Z of each text.

    ``bad`` is the log potential of "bad" (0 for "good"), ``change[a, b]`` of a
    line labelled a before one labelled b.  All texts go in step, longest first.
    """
    order = np.argsort(-sizes, kind="stable")
    lengths = sizes[order]
    offsets = (np.cumsum(sizes) - sizes)[order]
    n = len(bad)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    alpha[offsets, 1] = bad[offsets]
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(1, int(lengths[0]))]
    for t, k in enumerate(active, 1):
        at = offsets[:k] + t
        p = alpha[at - 1]
        alpha[at, 0] = np.logaddexp(p[:, 0] + change[0, 0], p[:, 1] + change[1, 0])
        alpha[at, 1] = np.logaddexp(p[:, 0] + change[0, 1], p[:, 1] + change[1, 1]) + bad[at]
    pairs = np.zeros((2, 2))
    ends = offsets + lengths - 1
    log_z = np.zeros(len(sizes))
    log_z[order] = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    z_of = np.zeros(n)
    z_of[:] = np.repeat(log_z, sizes)
    for t, k in reversed(list(enumerate(active, 1))):
        at = offsets[:k] + t
        good_next, bad_next = beta[at, 0], beta[at, 1] + bad[at]
        beta[at - 1, 0] = np.logaddexp(change[0, 0] + good_next, change[0, 1] + bad_next)
        beta[at - 1, 1] = np.logaddexp(change[1, 0] + good_next, change[1, 1] + bad_next)
        weight = 1 / lengths[:k]
        for a in (0, 1):
            for b, nxt in ((0, good_next), (1, bad_next)):
                pairs[a, b] += (np.exp(alpha[at - 1, a] + change[a, b] + nxt - z_of[at]) * weight).sum()
    marginal = np.exp(alpha[:, 1] + beta[:, 1] - z_of)
    return np.clip(marginal, 0, 1), pairs, log_z


@dataclass
class LineField:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3 * N_OWN))
    change: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 6.0
    shift: float = -3.0
    #: Score given whatever the text, where only one label was there to learn from.
    constant: float | None = None

    def line_marginals(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, lengths, sizes = line_features(texts)
        bad, _, _ = forward_backward(with_neighbours(own, sizes) @ self.weights, self.change, sizes)
        return 1 - bad, lengths, sizes

    def goodness(self, texts: list) -> np.ndarray:
        """Mean P(good) of a text's lines by their lengths."""
        good, lengths, sizes = self.line_marginals(texts)
        return _by_length(good, lengths, sizes)

    def score(self, texts: list) -> pa.Array:
        if not texts:
            return pa.array([], pa.float64())
        if self.constant is not None:
            return pa.array([self.constant] * len(texts), pa.float64())
        return pa.array(1 / (1 + np.exp(-(self.slope * self.goodness(texts) + self.shift))))


def _by_length(values: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    first = np.cumsum(sizes) - sizes
    total = np.add.reduceat(lengths, first)
    mean = np.add.reduceat(values * lengths, first) / np.maximum(total, 1)
    return np.where(total > 0, mean, np.add.reduceat(values, first) / sizes)


def fit_field(own: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, good: np.ndarray, rounds: int = 2, steps: int = 100) -> LineField:
    """Fit weights and changes by the gradient of the conditional likelihood, each text weighing the same."""
    model = LineField()
    if len(good) == 0 or good.all() or not good.any():
        model.constant = float(good.mean()) if len(good) else 0.5
        return model
    rows = with_neighbours(own, sizes)
    of_text = np.repeat(np.arange(len(sizes)), sizes)
    weight = 1 / sizes[of_text]
    first = np.cumsum(sizes) - sizes
    labels = (~good[of_text]).astype(float)
    for number in range(rounds):
        if number:
            marginal, _, _ = forward_backward(rows @ model.weights, model.change, sizes)
            worst = np.repeat(np.maximum.reduceat(marginal, first), sizes)
            labels = np.where(good[of_text], 0.0, ((marginal > 0.5) | (marginal == worst)).astype(float))
        inner = np.ones(len(labels), dtype=bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (labels[at - 1].astype(int), labels[at].astype(int)), weight[at])
        momentum = [np.zeros(rows.shape[1]), np.zeros((2, 2))]
        size = [np.zeros(rows.shape[1]), np.zeros((2, 2))]
        for step in range(1, steps + 1):
            marginal, pairs, _ = forward_backward(rows @ model.weights, model.change, sizes)
            slopes = [
                rows.T @ ((labels - marginal) * weight) / len(sizes) - 1e-4 * model.weights,
                (seen - pairs) / len(sizes) - 1e-2 * model.change,
            ]
            moved = []
            for i, slope in enumerate(slopes):
                momentum[i] = 0.9 * momentum[i] + 0.1 * slope
                size[i] = 0.99 * size[i] + 0.01 * slope**2
                moved.append(0.15 * (momentum[i] / (1 - 0.9**step)) / (np.sqrt(size[i] / (1 - 0.99**step)) + 1e-9))
            model.weights = model.weights + moved[0]
            model.change = model.change + moved[1]
    bad, _, _ = forward_backward(rows @ model.weights, model.change, sizes)
    x = _by_length(1 - bad, lengths, sizes)
    model.slope, model.shift = _logistic(x, good.astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, both kinds weighing the same."""
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    beta = np.array([6.0, -3.0])
    design = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        slope = design.T @ (weight * (y - p)) - 1e-2 * len(x) / 100 * np.array([beta[0] - 6.0, 0.0])
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.eye(2) * 1e-2 * len(x) / 100
        beta = beta + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return float(max(beta[0], 0.1)), float(beta[1])


def learn_quality(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> LineField:
    """Fit on at most ``sample`` good and ``sample`` bad documents outside the held-out fold.

    Which ones is decided by a hash of the id; their features, not their texts,
    come to the driver.
    """
    known = (
        labels.where(F.col("quality").isin(0, 1) & (fold() != HELD_OUT_FOLD)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    # At most 2 x sample rows: safe to broadcast.
    chosen = smallest_hashes(known.where("quality = 1"), sample).withColumn("good", F.lit(True)).union(
        smallest_hashes(known.where("quality = 0"), sample).withColumn("good", F.lit(False))
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                own, lengths, sizes = line_features(part.column(1).to_pylist())
                ends = np.cumsum(sizes)
                cut = [(own[e - s : e].astype(np.float32).tobytes(), lengths[e - s : e].tobytes()) for s, e in zip(sizes, ends)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([c[0] for c in cut], pa.binary()), pa.array([c[1] for c in cut], pa.binary())],
                    names=["doc_id", "good", "own", "lengths"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = rows.select("doc_id", "text", "good").mapInArrow(features, f"doc_id {kind}, good boolean, own binary, lengths binary")
    # A repeated id teaches once.
    got = table.dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    if not got:
        return LineField(constant=0.5)
    own = np.concatenate([np.frombuffer(r["own"], dtype=np.float32).reshape(-1, N_OWN) for r in got]).astype(float)
    lengths = [np.frombuffer(r["lengths"], dtype=np.int64) for r in got]
    return fit_field(
        own, np.concatenate(lengths), np.array([len(x) for x in lengths]), np.array([r["good"] for r in got], dtype=bool)
    )


def with_quality(docs: DataFrame, model: LineField, column: str = "quality_score") -> DataFrame:
    """Add the score (0 to 1, higher: better). Map-only."""
    return docs.withColumn(column, text_function(model.score, "double", rows=500)(F.col("text")))


def line_labels(docs: DataFrame, model: LineField) -> DataFrame:
    """doc_id, line, p_good of every line of every document. Map-only."""

    def label(texts: list) -> pa.Array:
        if not texts:
            return pa.array([], pa.list_(pa.float64()))
        good, _, sizes = model.line_marginals(texts)
        return pa.array(np.split(good, np.cumsum(sizes)[:-1]), pa.list_(pa.float64()))

    marked = docs.select("doc_id", text_function(label, "array<double>", rows=500)(F.col("text")).alias("lines"))
    return marked.select("doc_id", F.posexplode("lines").alias("line", "p_good"))


def score_quality(docs: DataFrame, labels: DataFrame, model: LineField | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = model or learn_quality(rows, labels)
    return with_quality(rows, model, "score").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
