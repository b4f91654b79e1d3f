"""Toxicity grades by cumulative-link ordinal regression over sparse word features.

One weight vector serves all ordered thresholds: P(grade > k) is a logistic
curve of (features x weights - threshold k).  Grades are 0 (clean) and 1 to 3
for toxic documents.  The labels only say toxic or not, so the grade of a
toxic training document is the third of the density of toxic words it falls in.
The expected severity is the sum of P(grade > k).

Defined results: NULL and empty texts have no features and get what the
thresholds alone say.  With labels of one kind only, P(toxic) is that kind's
share.  Long texts are read whole, a word counts wherever it stands.  Repeated rows are
scored each; an id that repeats teaches once, and is
toxic if any of its labels is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nbgauge.llm.common import HELD_OUT_FOLD, fold, held_out, smallest_hashes, text_function
from nbgauge.session import cut_lineage

GRADES = 4
RESULT = "severity double, p_toxic double, grade int"
_MARKS = bytes(32 if chr(c) in ".,;:!?\"'()[]{}<>|*#$%&/\\+=~`^_-" else c for c in range(256))


#: Lengths of the beginnings of a word that are features beside the word.
STEMS = (4, 5, 6)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_MARKS).split()


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in STEMS)]


class _Found(dict):
    """Numbers of the features of each word met so far; forgets when too many are kept."""

    def __init__(self, names: list[str]):
        super().__init__()
        self.place = {name: i for i, name in enumerate(names)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        found = {self.place[f] for f in features_of(word.decode()) if f in self.place}
        self[word] = tuple(sorted(found))
        return self[word]


@dataclass
class SeverityModel:
    names: list[str]  # words, and beginnings of words with a tilde
    weights: np.ndarray  # presence of each feature, then its rate
    thresholds: np.ndarray  # ascending, one below each grade but the first
    constant: float | None = None

    def __post_init__(self):
        self.found = _Found(self.names)

    def __getstate__(self):
        return {**self.__dict__, "found": _Found(self.names)}

    def counts(self, words: dict[bytes, int]) -> Counter:
        """How often each feature occurs among counted words."""
        hits: Counter = Counter()
        for word, n in words.items():
            for i in self.found[word]:
                hits[i] += n
        return hits

    def features(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows: text, feature, value."""
        rows, columns, values = [], [], []
        n = len(self.names)
        for r, text in enumerate(texts):
            words = tokens(text)
            hits = Counter(i for found in map(self.found.__getitem__, words) if found for i in found)
            for i, c in hits.items():
                rows += (r, r)
                columns += (i, n + i)
                values += (1.0, rate(c, len(words)))
        return np.array(rows, dtype=np.int64), np.array(columns, dtype=np.int64), np.array(values)

    def grades_above(self, texts: list) -> np.ndarray:
        """P(grade > k) for each text and k."""
        if self.constant is not None:
            return np.repeat([[self.constant] + [0.0] * (GRADES - 2)], len(texts), axis=0)
        rows, columns, values = self.features(texts)
        value = np.bincount(rows, weights=values * self.weights[columns], minlength=len(texts))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - value[:, None], -500, 500)))

    def score(self, texts: list) -> pa.Array:
        above = self.grades_above(texts) if texts else np.zeros((0, GRADES - 1))
        return pa.StructArray.from_arrays(
            [pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array((above >= 0.5).sum(axis=1).astype(np.int32))],
            names=["severity", "p_toxic", "grade"],
        )


def rate(count, total):
    """Occurrences per hundred words, on a log scale."""
    return np.log1p(100 * count / np.maximum(total, 1))


def fit_ordinal(rows, columns, values, grades, n_features: int, steps: int = 300, ridge: float = 1e-5):
    """Weights shared by all thresholds, by the gradient of the likelihood of the grades."""
    n, k = len(grades), GRADES - 1
    weights, thresholds = np.zeros(n_features), np.array([0.5, 1.5, 2.5])[:k]
    # Both kinds weigh the same.
    toxic = grades > 0
    weight = np.where(toxic, 0.5 / max(toxic.mean(), 1e-9), 0.5 / max(1 - toxic.mean(), 1e-9)) / n
    momentum, size = np.zeros(n_features + k), np.zeros(n_features + k)
    for step in range(1, steps + 1):
        value = np.bincount(rows, weights=values * weights[columns], minlength=n)
        above = 1 / (1 + np.exp(np.clip(thresholds[None, :] - value[:, None], -500, 500)))
        full = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        here = np.arange(n)
        p = np.maximum(full[here, grades] - full[here, grades + 1], 1e-9)
        bend = full * (1 - full)
        by_value = (bend[here, grades] - bend[here, grades + 1]) / p * weight
        by_threshold = np.zeros(k + 2)
        np.add.at(by_threshold, grades, -bend[here, grades] / p * weight)
        np.add.at(by_threshold, grades + 1, bend[here, grades + 1] / p * weight)
        slope = np.concatenate([
            np.bincount(columns, weights=values * by_value[rows], minlength=n_features) - ridge * weights, by_threshold[1:-1]
        ])
        momentum = 0.9 * momentum + 0.1 * slope
        size = 0.99 * size + 0.01 * slope**2
        move = 0.1 * (momentum / (1 - 0.9**step)) / (np.sqrt(size / (1 - 0.99**step)) + 1e-9)
        weights = weights + move[:n_features]
        # The order of the thresholds is kept.
        thresholds = np.maximum.accumulate(thresholds + move[n_features:])
        thresholds = thresholds + 1e-3 * np.arange(k)
    return weights, thresholds


def learn_toxicity(
    docs: DataFrame, labels: DataFrame, sample: int = 3000, least_docs: int = 4, least_gain: float = 20.0
) -> SeverityModel:
    """Fit on at most ``sample`` toxic and ``sample`` clean documents outside the held-out fold.

    Features are all words and beginnings of words that tell more about the label
    than chance would (mutual information of the document frequencies; ``least_gain``
    is twice the nats over the sample); the counting is Spark's, the sparse counts of
    the sample come to the driver.
    """
    known = (
        labels.where(F.col("toxic").isin(0, 1) & (fold() != HELD_OUT_FOLD)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    # At most 2 x sample rows: safe to broadcast.
    chosen = smallest_hashes(known.where("toxic = 1"), sample).withColumn("toxic", F.lit(1)).union(
        smallest_hashes(known.where("toxic = 0"), sample).withColumn("toxic", F.lit(0))
    )
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, toxic in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                found = tokens(text)
                items = sorted(Counter(found).items()) or [(b"", 0)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc], pa.string()), pa.array([toxic], pa.int32()), pa.array([len(found)], pa.int64()),
                        pa.array([[w.decode() for w, _ in items]], pa.list_(pa.string())), pa.array([[c for _, c in items]], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "toxic", "total", "words", "counts"],
                )

    counted = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("string"), "text", "toxic")
    counted = counted.mapInArrow(count, "doc_id string, toxic int, total long, words array<string>, counts array<long>")
    counted = cut_lineage(counted.dropDuplicates(["doc_id"]))
    sizes = {r["toxic"]: r["count"] for r in counted.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return SeverityModel([], np.zeros(0), np.zeros(GRADES - 1), constant=float(next(iter(sizes), 0)))
    expanded = F.array_distinct(F.flatten(F.transform(
        F.filter("words", lambda w: w != ""),
        lambda w: F.array(w, *[F.concat(F.substring(w, 1, n), F.lit("~")) for n in STEMS]),
    )))
    names = counted.select("toxic", F.explode(expanded).alias("name"))
    frequency = names.groupBy("name").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("fine")).where(f"bad + fine >= {least_docs}")
    bad, fine = F.col("bad"), F.col("fine")
    n, n_bad, n_fine = sum(sizes.values()), sizes[1], sizes[0]

    def information(cell: F.Column, row: F.Column, column: int) -> F.Column:
        return F.when(cell > 0, cell / n * F.log(cell * n / (row * column))).otherwise(0.0)

    here, absent = bad + fine, F.lit(n) - bad - fine
    tells = (
        information(bad, here, n_bad) + information(fine, here, n_fine)
        + information(n_bad - bad, absent, n_bad) + information(n_fine - fine, absent, n_fine)
    )
    p, q = (bad + 0.5) / (n_bad + 1), (fine + 0.5) / (n_fine + 1)
    odds = F.log(p / (1 - p)) - F.log(q / (1 - q))
    top = frequency.select("name", odds.alias("odds"), tells.alias("tells")).where(F.col("tells") * (2 * n) >= least_gain).orderBy(F.desc("tells"), "name").collect()
    model = SeverityModel([r["name"] for r in top], np.zeros(2 * len(top)), np.zeros(GRADES - 1))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [
                model.counts({w.encode(): c for w, c in zip(words, counts) if w})
                for words, counts in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([list(h) for h in hits], pa.list_(pa.int32())), pa.array([list(h.values()) for h in hits], pa.list_(pa.int64()))],
                names=["doc_id", "toxic", "total", "ids", "counts"],
            )

    # Counts of the features in the sample's documents.
    sample_rows = counted.mapInArrow(project, "doc_id string, toxic int, total long, ids array<int>, counts array<long>").orderBy("doc_id").collect()
    cells = [(r, i, c, row["total"]) for r, row in enumerate(sample_rows) for i, c in zip(row["ids"], row["counts"])]
    table = pd.DataFrame(cells, columns=["row", "word", "count", "total"])
    toxic = np.array([r["toxic"] for r in sample_rows])
    # Features far commoner in toxic documents make up the density that grades them.
    strong = np.array([r["odds"] > 2 for r in top], dtype=bool)
    hits = table[strong[table["word"].to_numpy(dtype=int)]] if len(table) else table
    density = np.bincount(hits["row"].to_numpy(dtype=int), weights=(hits["count"] / hits["total"].clip(lower=1)).to_numpy(dtype=float), minlength=len(toxic))
    cuts = np.quantile(density[toxic == 1], [1 / 3, 2 / 3])
    grades = np.where(toxic == 1, 1 + (density[:, None] > cuts[None, :]).sum(axis=1), 0)
    rows, word = table["row"].to_numpy(dtype=np.int64), table["word"].to_numpy(dtype=np.int64)
    values = rate(table["count"].to_numpy(dtype=float), table["total"].to_numpy(dtype=float))
    model.weights, model.thresholds = fit_ordinal(
        np.concatenate([rows, rows]), np.concatenate([word, word + len(top)]), np.concatenate([np.ones(len(word)), values]), grades, 2 * len(top)
    )
    return model


def with_severity(docs: DataFrame, model: SeverityModel, column: str = "toxicity") -> DataFrame:
    """Add a struct of the expected severity, P(toxic) and the grade. Map-only."""
    return docs.withColumn(column, text_function(model.score, RESULT)(F.col("text")))


def score_toxicity(docs: DataFrame, labels: DataFrame, model: SeverityModel | None = None) -> DataFrame:
    """doc_id, held_out, severity, score (P(toxic)), grade, toxic of every document."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = model or learn_toxicity(rows, labels)
    return with_severity(rows, model, "t").select(
        "doc_id", held_out().alias("held_out"), "t.severity", F.col("t.p_toxic").alias("score"), "t.grade",
        (F.col("t.p_toxic") >= 0.5).cast("int").alias("toxic"),
    )
