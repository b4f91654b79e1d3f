"""A learned text representation: vectors of subwords with a linear head, trained together.

A text is the weighted mean of the vectors of its subwords: every word and its
runs of three to five characters, each kept under one of ``buckets`` hashes.  A
word adds log(1 + count), shared among its subwords and weighted by how rare a
bucket is; the weights of a text have length one.  The head tells two classes
from the mean.

Training reads the texts once and writes their buckets, many texts a row, as short
numbers: a bucket, and the place of its weight among the different weights of the
row.  A round then reads that table, kept in memory as far as it goes: with the head
``h`` and the vectors ``E`` a text's margin needs one number per bucket, ``E @ h``,
and the gradient of a bucket's vector is ``h`` times one number per bucket.  So a
round ships ``buckets`` numbers and gets as many back, added by Spark, whatever the
size of the table.  Parts are whole numbers (units of 2^-50) before they are added,
so neither order nor partitions change a model.

NULL texts and texts without a word have no buckets; their margin is the bias.
Rows without a label are left out of training; labels other than 0 and 1 are
refused.  One class alone gives a model that always answers it.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nbgauge.session import shared_dir

RUNS = (3, 4, 5)
#: Words up to this length are hashed together.
SHORT = 40
UNIT = 2.0**50
#: Characters of the texts that are cut into subwords together, and share a row: what is worked out for them fits a processor's cache.
CHARS = 1 << 16
#: Subwords a task reads per round, at least, and buckets that are added together.
PART, SLICE = 1 << 22, 1 << 12
#: ``sizes``: subwords of each text (int32); ``ids`` and ``places``: see ``_kind``; ``weights``: the different ones (double).
BAGS = "labels array<double>, subwords bigint, sizes binary, ids binary, places binary, weights binary"
TABLE = "bucket int, rarity double, vector array<double>"

_WORD = re.compile(r"\w+")


def _hashes(word: str, buckets: int) -> np.ndarray:
    marked = f"<{word}>"
    found = {zlib.crc32(marked[i : i + n].encode("utf-8", "surrogatepass")) % buckets for n in RUNS for i in range(len(marked) - n + 1)}
    found.add(zlib.crc32(marked.encode("utf-8", "surrogatepass")) % buckets)
    return np.array(sorted(found), np.int64)


def _crc_steps() -> np.ndarray:
    """What CRC-32 does with each byte."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, steps >> 1 ^ np.uint32(0xEDB88320), steps >> 1)
    return steps


_STEPS = _crc_steps()


def _stepped(state: np.ndarray, data: np.ndarray, here: np.ndarray, end: np.ndarray | None) -> np.ndarray:
    """CRC-32 of what came before and one character more, of one byte or up to ``end``."""
    state = _STEPS.take(state.astype(np.uint8) ^ data.take(here)) ^ state >> 8
    for k in range(1, 1 if end is None else int((end - here).max(initial=1))):
        on = np.flatnonzero(end - here > k)
        state[on] = _STEPS[state[on].astype(np.uint8) ^ data[here[on] + k]] ^ state[on] >> 8
    return state


def _hashed_together(words: list[str], sizes: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the runs of each length, all at once, and of the whole words; and the word each is in."""
    raw = "".join([f"<{w}>" for w in words]).encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    ends = np.cumsum(sizes + 2)
    # Where characters begin, if some have more than one byte.
    begin = None if len(data) == ends[-1:].sum() else np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    word = np.repeat(np.arange(len(words)), sizes + 2)
    left = np.repeat(ends, sizes + 2) - np.arange(len(word))
    fresh = np.uint32(0xFFFFFFFF)
    at = np.flatnonzero(left >= min(RUNS))
    state = np.full(len(at), fresh)
    for n in range(1, max(RUNS) + 1):
        if n > min(RUNS):
            # Characters that have n - 1 more of their word behind them.
            on = np.flatnonzero(left.take(at) >= n)
            at, state = at.take(on), state.take(on)
        here = at + (n - 1)
        state = _stepped(state, data, here, None) if begin is None else _stepped(state, data, begin[here], begin[here + 1])
        if n in RUNS:
            yield word.take(at), (state ^ fresh) % buckets
    ends = (ends if begin is None else begin[ends]).tolist()
    yield np.arange(len(words)), np.array([zlib.crc32(raw[a:b]) % buckets for a, b in zip([0, *ends], ends)], np.int64)


def _buckets_of(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words one after the other, ascending in a word and each once, and their number per word."""
    lengths = np.array([*map(len, words)], np.int64)
    short = np.flatnonzero(lengths <= SHORT)
    some = words if len(short) == len(words) else [words[i] for i in short]
    keys = [(short * buckets).take(word) + found for word, found in _hashed_together(some, lengths[short], buckets)]
    keys += [i * buckets + _hashes(words[i], buckets) for i in np.flatnonzero(lengths > SHORT)]
    keys = np.sort(np.concatenate(keys))
    keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
    walls = np.arange(len(words) + 1) * buckets
    sizes = np.diff(np.searchsorted(keys, walls))
    return keys - np.repeat(walls[:-1], sizes), sizes


def _kind(n: int) -> type:
    """The type of numbers below ``n``."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def _bags_of(texts: list[str | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    counts = [Counter(_WORD.findall(t.lower() if t else "")) for t in texts]
    known: dict[str, int] = {}
    at = np.array([known.setdefault(w, len(known)) for c in counts for w in c], np.int64)
    ids, sizes = _buckets_of(list(known), buckets)
    ids, starts, sizes = ids.astype(_kind(buckets)), (np.cumsum(sizes) - sizes)[at], sizes[at]
    shares = np.log1p(np.array([n for c in counts for n in c.values()], float)) / np.sqrt(sizes)
    end = 0
    for c in counts:
        own, end = slice(end, end + len(c)), end + len(c)
        if not c:
            yield np.zeros(0, _kind(buckets)), np.zeros(0)
            continue
        n = sizes[own]
        flat = ids.take(np.arange(n.sum()) + np.repeat(starts[own] - (np.cumsum(n) - n), n))
        # Equal buckets stay in the order of the words: their sum does not depend on the other texts.
        order = flat.argsort(kind="stable")
        flat = flat.take(order)
        new = np.append(True, flat[1:] != flat[:-1])
        yield flat[new], np.bincount(np.cumsum(new) - 1, np.repeat(shares[own], n).take(order))


def _together(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """Texts in lists of ``CHARS`` characters; an empty text counts as one, a longer text is a list alone."""
    part, chars = [], 0
    for text in texts:
        n = len(text or "") + 1
        if part and chars + n > CHARS:
            yield part
            part, chars = [], 0
        part.append(text)
        chars += n
    if part:
        yield part


def bags(texts: Iterable[str | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each text, ascending, and their weights before rarity and length."""
    for part in _together(texts):
        yield from _bags_of(part, buckets)


def bag(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return next(bags([text], buckets))


def _scaled(weights: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    weights = weights * rarity
    length = np.sqrt(weights @ weights)
    return weights / length if length > 0 else weights


def _counted(values: np.ndarray) -> pa.RecordBatch:
    """Whole numbers, one per bucket, ``SLICE`` buckets a row."""
    parts = [values[i : i + SLICE].astype(np.int64).tobytes() for i in range(0, len(values), SLICE)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "total"])


def _slices_added(rows: pa.Table) -> pa.Table:
    total = 0
    for part in rows["total"]:
        total = total + np.frombuffer(part.as_buffer(), np.int64)
    return pa.table({"slice": rows["slice"][:1], "total": pa.array([total.tobytes()], pa.binary())})


def _added(df: DataFrame, part, buckets: int) -> np.ndarray:
    """Numbers per bucket of all tasks, added slice by slice."""
    kind = "slice int, total binary"
    rows = df.mapInArrow(part, kind).groupBy("slice").applyInArrow(_slices_added, kind).toArrow()
    total = np.zeros(buckets + 1)
    for i, values in zip(rows["slice"].to_pylist(), rows["total"]):
        found = np.frombuffer(values.as_buffer(), np.int64)
        total[i * SLICE : i * SLICE + len(found)] = found
    return total


def _row(labels: list[float], found: list[tuple[np.ndarray, np.ndarray]]) -> dict:
    """The bags of some texts as a row of ``BAGS``."""
    sizes = np.array([len(ids) for ids, _ in found], np.int32)
    weights, places = np.unique(np.concatenate([x for _, x in found]), return_inverse=True)
    ids = np.concatenate([ids for ids, _ in found])
    columns = {"sizes": sizes, "ids": ids, "places": places.astype(_kind(len(weights))), "weights": weights}
    return {"labels": labels, "subwords": len(ids)} | {k: v.tobytes() for k, v in columns.items()}


def _ids(value: pa.Scalar, buckets: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), _kind(buckets))


def _weighted(row: dict, ids: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subwords of each text of a row, and the weights with rarity before length."""
    weights = np.frombuffer(row["weights"].as_buffer())
    places = np.frombuffer(row["places"].as_buffer(), _kind(len(weights)))
    return np.frombuffer(row["sizes"].as_buffer(), np.int32), weights.take(places.astype(np.intp)) * rarity.take(ids)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for values in zip(*batch.columns):
        yield dict(zip(batch.schema.names, values))


def _written(rows: DataFrame) -> DataFrame:
    path = f"{shared_dir(rows.sparkSession)}/subwords-{uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(BAGS).parquet(path)


@dataclass
class SubwordModel:
    """Vectors and rarity per bucket, the head, and the text column it reads."""

    vectors: np.ndarray
    rarity: np.ndarray
    head: np.ndarray
    bias: float
    text_col: str = "text"
    info: dict = field(default_factory=dict)

    def _per_text(self, function, kind: str):
        rarity, buckets = self.rarity, len(self.rarity)

        def answer(texts: pd.Series) -> pd.Series:
            out = [function(ids, _scaled(weights, rarity[ids])) for ids, weights in bags(texts, buckets)]
            return pd.Series(out, index=texts.index)

        return F.pandas_udf(answer, kind)(F.col(f"`{self.text_col}`").cast("string"))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``score`` (0 to 1) and ``prediction``. Map-only."""
        weight, bias = self.vectors @ self.head, self.bias
        margin = self._per_text(lambda ids, x: float(x @ weight[ids]) + bias, "double")
        scored = df.withColumn("score", 1 / (1 + F.exp(-margin)))
        return scored.withColumn("prediction", (F.col("score") >= 0.5).cast("double"))

    def embed(self, df: DataFrame, column: str = "vector") -> DataFrame:
        """Add the vector of every text; of a text without words, zeros. Map-only."""
        vectors = self.vectors
        return df.withColumn(column, self._per_text(lambda ids, x: (x @ vectors[ids]).tolist(), "array<double>"))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, float(r), v.tolist()) for i, (r, v) in enumerate(zip(self.rarity, self.vectors))]
        spark.createDataFrame(rows, TABLE).coalesce(1).write.mode("overwrite").parquet(f"{path}/subwords")
        about = {"head": self.head.tolist(), "bias": self.bias, "text_col": self.text_col, "info": self.info}
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").json(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SubwordModel:
        about = json.loads(spark.read.schema("about string").json(f"{path}/about").first()["about"])
        # One row per bucket.
        rows = spark.read.schema(TABLE).parquet(f"{path}/subwords").orderBy("bucket").collect()
        vectors, rarity = np.array([r["vector"] for r in rows]), np.array([r["rarity"] for r in rows])
        return cls(vectors, rarity, np.array(about["head"]), about["bias"], about["text_col"], about["info"])


@dataclass
class SubwordLearner:
    """Full gradients with momentum; both classes weigh the same."""

    buckets: int = 1 << 16
    size: int = 16
    rounds: int = 40
    step: float = 10.0
    head_step: float = 0.1
    momentum: float = 0.9
    seed: int = 1

    def bags(self, df: DataFrame, text_col: str, label: str) -> DataFrame:
        """Labels and buckets of all labelled texts, written once."""
        buckets, schema = self.buckets, pa.schema(
            [("labels", pa.list_(pa.float64())), ("subwords", pa.int64()), *[(c, pa.binary()) for c in ("sizes", "ids", "places", "weights")]]
        )

        def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                labels = iter(batch.column(0).to_pylist())
                for part in _together(batch.column(1).to_pylist()):
                    found = list(_bags_of(part, buckets))
                    yield pa.RecordBatch.from_pylist([_row([next(labels) for _ in part], found)], schema)

        rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), F.col(f"`{text_col}`").cast("string").alias("text"))
        return _written(rows.mapInArrow(prepare, BAGS))

    def rarity(self, rows: DataFrame, n: int) -> np.ndarray:
        """log((1 + texts) / (1 + texts that have the bucket))."""
        buckets = self.buckets

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(buckets, np.int64)
            for batch in batches:
                for ids in batch.column(0):
                    # A text has a bucket once.
                    total += np.bincount(_ids(ids, buckets), minlength=buckets)
            yield _counted(total)

        return np.log((1 + n) / (1 + _added(rows.select("ids"), count, buckets)[:buckets]))

    def measured(self, rows: DataFrame, rarity: np.ndarray) -> DataFrame:
        """The bags with the length of every text."""
        buckets = self.buckets

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for row in _rows(batch):
                    sizes, x = _weighted(row, _ids(row["ids"], buckets), rarity)
                    ends = np.cumsum(sizes)
                    lengths = np.array([np.sqrt(x[a:b] @ x[a:b]) for a, b in zip(ends - sizes, ends)])
                    # Weights of zero stay as they are.
                    found.append(np.where(lengths > 0, lengths, 1.0).tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "lengths"])

        return rows.mapInArrow(measure, f"{BAGS}, lengths binary")

    def gradient(self, rows: DataFrame, rarity: np.ndarray, weight: np.ndarray, bias: float, shares: dict) -> tuple[np.ndarray, float]:
        """Per bucket the sum of residual times share; of all texts the sum of residuals."""
        buckets = self.buckets

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(buckets + 1)
            for batch in batches:
                # One row at a time: its numbers stay in the processor's cache.
                for row in _rows(batch):
                    ids = _ids(row["ids"], buckets).astype(np.intp)
                    sizes, x = _weighted(row, ids, rarity)
                    x /= np.repeat(np.frombuffer(row["lengths"].as_buffer()), sizes)
                    label = row["labels"].values.to_numpy()
                    text = np.repeat(np.arange(len(sizes)), sizes)
                    margin = np.clip(np.bincount(text, x * weight.take(ids), len(sizes)) + bias, -30, 30)
                    residual = (1 / (1 + np.exp(-margin)) - label) * np.where(label == 1, shares[1.0], shares[0.0])
                    # Whole numbers that add up to less than 2^53: exact as doubles.
                    np.add.at(total, ids, np.rint(x * np.repeat(residual * UNIT, sizes)))
                    total[buckets] += np.rint(residual * UNIT).sum()
            yield _counted(total)

        total = _added(rows, add, buckets) / UNIT
        return total[:buckets], float(total[buckets])

    def fit(self, df: DataFrame, text_col: str = "text", label: str = "label") -> SubwordModel:
        rows = self.bags(df, text_col, label)
        found = rows.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n")).collect()
        counts = {r["label"]: r["n"] for r in found}
        parts = max(1, -(-(rows.agg(F.sum("subwords")).first()[0] or 0) // PART))
        if set(counts) - {0.0, 1.0}:
            raise ValueError("labels are 0 and 1")
        draw = np.random.default_rng(self.seed)
        vectors = draw.normal(0, 0.1, (self.buckets, self.size))
        head = draw.normal(0, self.size**-0.5, self.size)
        info = {"learner": "subwords", "rounds": self.rounds, "size": self.size, "step": self.step}
        if len(counts) < 2:
            bias = 30.0 if 1.0 in counts else -30.0 if counts else 0.0
            return SubwordModel(vectors, np.ones(self.buckets), np.zeros(self.size), bias, text_col, info)
        rarity = self.rarity(rows, sum(counts.values()))
        # Every task answers with its numbers per bucket: small tables need few.
        rows = self.measured(rows, rarity).coalesce(parts).persist()
        shares = {c: 0.5 / n for c, n in counts.items()}
        bias, moved_vectors, moved_head, moved_bias = 0.0, np.zeros_like(vectors), np.zeros_like(head), 0.0
        for _ in range(self.rounds):
            slope, residual = self.gradient(rows, rarity, vectors @ head, bias, shares)
            moved_vectors = self.momentum * moved_vectors - self.step * np.outer(slope, head)
            moved_head = self.momentum * moved_head - self.head_step * (vectors.T @ slope)
            moved_bias = self.momentum * moved_bias - self.head_step * self.step * residual
            vectors, head, bias = vectors + moved_vectors, head + moved_head, bias + moved_bias
        rows.unpersist()
        return SubwordModel(vectors, rarity, head, bias, text_col, info)


def train_subword_model(df: DataFrame, text_col: str = "text", **params) -> SubwordModel:
    """Fit on a text column and ``label``; takes the place of ``train_text_model``."""
    return SubwordLearner(**params).fit(df, text_col)
