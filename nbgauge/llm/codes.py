"""Vector code compression: product codes trained by rounds with adaptive distance bounds.

Vectors are turned into integers, floor(scale * x), and cut into equal consecutive
parts.  Each part position has a codebook of at most ``entries`` entries.  A round
assigns every part to its nearest entry, then moves each entry to the floored mean of
its parts.  All distances that decide are integers, so the result does not depend on
how the table is partitioned.

Few distances are worked out.  For every part a written table keeps its entry, an upper
bound of the distance to it, the ``b`` next entries with lower bounds in ascending order,
and one lower bound for all others.  When entries move, bounds are widened by how far
they moved; the upper bound then tells how many of the ordered bounds must be looked at:
none, the first few (compared as integers), or, beyond the outer bound, all entries.
After each round ``b`` shrinks to what nearly all parts needed.

Only codebooks (``entries`` times the vector's length) reach the driver and the tasks.
Sums per entry are added up in each task first, then by groups.  The state of a round is
a Parquet table in the shared folder, so a lost executor costs its tasks only.

Defined results: vectors that are NULL, empty or hold NULL or non-finite components are
dropped.  The length is that of the smallest id's vector; vectors of another length are
dropped too.  A length that four does not divide is filled up with zeros.  Repeated rows
and ids are coded each for itself; among equal ids the smaller vector comes first into
the codebook.  With fewer vectors than entries the codebook is as short.  NULL ids come
last.  Components beyond ``LARGEST`` after scaling are refused with a ValueError, as
their distances leave 64 bits.  Other columns are ignored; an empty table gives no rows.
Texts play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nbgauge.llm.common import written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Ordered bounds that a part starts with, and the share of parts that may need more after a round.
START_BOUNDS, RESCANNED = 24, 0.02
LARGEST = 1 << 22
#: Bounds are doubles of integer distances; the margin covers all their rounding.
MARGIN = 1e-9
CHUNK = 2_000

_STATE = (
    "components array<int>, code array<int>, upper array<double>, near array<int>, lower array<double>, outer array<double>, looked array<int>"
)


def usable(vector: str = "embedding") -> F.Column:
    """Whether a vector is there and all its components are finite."""
    value = F.col(vector)
    wrong = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(value) > 0) & ~wrong, F.lit(False))


def distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries, exact."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * points.shape[1] * most * most < 1 << 53 else np.int64
    p, e = points.astype(kind), book.astype(kind)
    out = (p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)[None]
    return out.astype(np.int64)


def scan(points: np.ndarray, book: np.ndarray, bounds: int):
    """Code, distance, next entries with their bounds, and the outer bound, from all entries."""
    k = len(book)
    codes, uppers, nears, lowers, outers = [], [], [], [], []
    for at in range(0, max(1, len(points)), CHUNK):
        # One number orders by distance, then by index.
        key = distances(points[at : at + CHUNK], book) * k + np.arange(k)
        last = min(bounds + 2, k)
        best = np.sort(np.partition(key, last - 1, axis=1)[:, :last] if last < k else key, axis=1)
        index, reach = best % k, np.sqrt((best // k).astype(np.float64))
        codes.append(index[:, 0])
        uppers.append(reach[:, 0])
        nears.append(index[:, 1 : bounds + 1])
        lowers.append(reach[:, 1 : bounds + 1])
        outers.append(reach[:, bounds + 1] if last == bounds + 2 else np.full(len(best), np.inf))
    return tuple(np.concatenate(x) for x in (codes, uppers, nears, lowers, outers))


def reassign(points: np.ndarray, book: np.ndarray, moved: np.ndarray, code, upper, near, lower, outer):
    """The state of one part position after its entries moved, and how many bounds each part had to look at."""
    n, bounds = near.shape
    upper = upper + moved[code]
    walls = np.concatenate([lower - moved[near], (outer - moved.max(initial=0.0))[:, None]], axis=1)
    # Ordered again: what stands behind may not be nearer than its own bound says.
    walls = np.minimum.accumulate(walls[:, ::-1], axis=1)[:, ::-1]
    code, near, outer = code.copy(), near.copy(), walls[:, -1].copy()

    def needed(rows: np.ndarray) -> np.ndarray:
        return (upper[rows, None] * (1 + MARGIN) + MARGIN >= walls[rows] * (1 - MARGIN)).sum(axis=1)

    looked = needed(np.arange(n))
    open_ = np.flatnonzero(looked)
    # The true distance to the own entry settles many of them.
    upper[open_] = np.sqrt(((points[open_] - book[code[open_]]) ** 2).sum(axis=1).astype(np.float64))
    looked[open_] = needed(open_)
    lower = walls[:, :-1].copy()
    for first in np.unique(looked):
        rows = np.flatnonzero(looked == first)
        if first == 0:
            continue
        if first > bounds:
            code[rows], upper[rows], near[rows], lower[rows], outer[rows] = scan(points[rows], book, bounds)
            continue
        for at in range(0, len(rows), CHUNK):
            some = rows[at : at + CHUNK]
            tried = np.concatenate([code[some, None], near[some, :first]], axis=1)
            exact = ((points[some, None] - book[tried]) ** 2).sum(axis=2)
            order = np.lexsort((tried, exact), axis=1)
            tried, exact = np.take_along_axis(tried, order, 1), np.sqrt(np.take_along_axis(exact, order, 1).astype(np.float64))
            code[some], upper[some] = tried[:, 0], exact[:, 0]
            near[some, :first], lower[some, :first] = tried[:, 1:], exact[:, 1:]
    return code, upper, near, lower, outer, looked


def _matrix(column, rows: int, kind) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind, copy=False).reshape(rows, -1)


def _lists(values: np.ndarray, kind) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(values).ravel(), kind))


def _state(components, code, upper, near, lower, outer, looked) -> list[pa.Array]:
    """Columns of the state, parts side by side."""
    side = lambda x: np.stack(x, axis=1).reshape(len(components), -1)
    return [
        _lists(components, pa.int32()), _lists(side(code), pa.int32()), _lists(side(upper), pa.float64()), _lists(side(near), pa.int32()),
        _lists(side(lower), pa.float64()), _lists(side(outer), pa.float64()), _lists(side(looked), pa.int32()),
    ]


def start(vectors: DataFrame, books: np.ndarray, bounds: int) -> DataFrame:
    """First state: every part compared with all entries of its codebook."""
    parts, _, width = books.shape

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column(2), len(batch), np.int64) if len(batch) else np.zeros((0, parts * width), np.int64)
            found = [scan(values[:, p * width : (p + 1) * width], books[p], bounds) for p in range(parts)]
            looked = [np.full(len(batch), bounds + 1)] * parts
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_state(values, *zip(*found), looked)], names=names)

    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label {vectors.schema['label'].dataType.simpleString()}, {_STATE}"
    names = ["vec_id", "label", *T.StructType.fromDDL(_STATE).names]
    return vectors.mapInArrow(compute, schema)


def advance(state: DataFrame, books: np.ndarray, moved: np.ndarray, bounds: int) -> DataFrame:
    """State after the entries moved by ``moved`` to ``books``; ``bounds`` ordered bounds are kept."""
    parts, _, width = books.shape

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            columns = dict(zip(names, batch.columns))
            n = len(batch)
            values = _matrix(columns["components"], n, np.int64)
            code, upper, outer = (_matrix(columns[c], n, kind) for c, kind in (("code", np.int64), ("upper", np.float64), ("outer", np.float64)))
            near, lower = _matrix(columns["near"], n, np.int64).reshape(n, parts, -1), _matrix(columns["lower"], n, np.float64).reshape(n, parts, -1)
            found = []
            for p in range(parts):
                # A shorter list: what is cut off goes under the outer bound.
                beyond = np.minimum(outer[:, p], lower[:, p, bounds:].min(axis=1, initial=np.inf))
                found.append(
                    reassign(values[:, p * width : (p + 1) * width], books[p], moved[p], code[:, p], upper[:, p], near[:, p, :bounds], lower[:, p, :bounds], beyond)
                )
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *_state(values, *zip(*found))], names=names)

    names = state.columns
    return state.mapInArrow(compute, state.schema)


def entry_sums(state: DataFrame, parts: int, width: int) -> DataFrame:
    """part, entry, place, total, n: componentwise sums of the parts of each entry in use."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * ENTRIES, width), np.int64), np.zeros(parts * ENTRIES, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            values = _matrix(batch.column(0), len(batch), np.int64).reshape(-1, width)
            slots = (_matrix(batch.column(1), len(batch), np.int64) + np.arange(parts) * ENTRIES).ravel()
            order = np.argsort(slots, kind="stable")
            used, first = np.unique(slots[order], return_index=True)
            sums[used] += np.add.reduceat(values[order], first, axis=0)
            counts += np.bincount(slots, minlength=len(counts))
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used]), _lists(sums[used], pa.int64())], names=["slot", "n", "sums"])

    partial = state.select("components", "code").mapInArrow(add, "slot long, n long, sums array<long>")
    return (
        partial.select("slot", "n", F.posexplode("sums").alias("place", "total"))
        .groupBy("slot", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        .select(F.expr(f"int(slot div {ENTRIES})").alias("part"), F.expr(f"int(slot % {ENTRIES})").alias("entry"), "place", "total", "n")
    )


def moved_books(books: np.ndarray, sums: list) -> tuple[np.ndarray, np.ndarray]:
    """Entries at the floored means of their parts (unused ones stay), and how far each went at most."""
    out = books.copy()
    for part, entry, place, total, n in sums:
        out[part, entry, place] = total // n
    return out, np.sqrt(((out - books) ** 2).sum(axis=2).astype(np.float64)) * (1 + MARGIN)


def fewer_bounds(state: DataFrame, bounds: int) -> int:
    """The least list length that would have spared all but a few parts the scan of all entries."""
    counts = {r["looked"]: r["count"] for r in state.select(F.explode("looked").alias("looked")).groupBy("looked").count().collect()}
    allowed, beyond = RESCANNED * sum(counts.values()), 0
    for length in range(bounds, 0, -1):
        beyond += counts.get(length + 1, 0)
        if beyond + counts.get(length, 0) > allowed:
            return length
    return min(bounds, 1)


def integer_vectors(embeddings: DataFrame, scale: int = SCALE, parts: int = PARTS) -> tuple[DataFrame, int]:
    """vec_id, label and integer components of the vectors that take part, and the width of a part."""
    kept = embeddings.where(usable()).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    if not first:
        return kept.select("vec_id", "label", F.array().cast("array<int>").alias("components")), 0
    length = len(first[0]["vector"])
    width = -(-length // parts)
    scaled = F.transform("vector", lambda x: F.floor(x * scale))
    large = F.exists("vector", lambda x: F.abs(x) >= LARGEST // scale)
    checked = F.when(large, F.raise_error(F.lit(f"components of {LARGEST // scale} or more are beyond the exact distances"))).otherwise(scaled)
    filled = F.concat(checked.cast("array<int>"), F.array_repeat(F.lit(0), parts * width - length))
    return kept.where(F.size("vector") == length).select("vec_id", "label", filled.alias("components")), width


def train(embeddings: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, bounds: int = START_BOUNDS, parts: int = PARTS) -> tuple[DataFrame, np.ndarray]:
    """The state after the last assignment, and the codebooks (part, entry, component)."""
    if not 1 <= entries <= ENTRIES:
        raise ValueError(f"a code has two hex digits: 1 to {ENTRIES} entries")
    vectors, width = integer_vectors(embeddings, parts=parts)
    smallest = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "components").limit(entries).collect() if width else []
    books = np.array([r["components"] for r in smallest], np.int64).reshape(-1, parts, max(width, 1)).transpose(1, 0, 2).copy()
    if not smallest:
        return start(vectors, np.zeros((parts, 1, 1), np.int64), 0).limit(0), books
    bounds = min(bounds, len(smallest) - 1)
    state = written(start(vectors, books, bounds), "codes")
    for turn in range(rounds):
        books, moved = moved_books(books, entry_sums(state, parts, width).collect())
        if turn:
            bounds = fewer_bounds(state, bounds)
        state = written(advance(state, books, moved, bounds), "codes")
    return state, books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(embeddings: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, bounds: int = START_BOUNDS) -> DataFrame:
    """vec_id, code, error, label_error and the digest of the codebooks, one row per vector that takes part."""
    state, books = train(embeddings, entries, rounds, bounds)
    parts, _, width = books.shape

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            values = _matrix(batch.column(2), len(batch), np.int64).reshape(len(batch), parts, width)
            code = _matrix(batch.column(3), len(batch), np.int64)
            nearest = np.stack([books[p][code[:, p]] for p in range(parts)], axis=1)
            error = ((values - nearest) ** 2).sum(axis=(1, 2))
            texts = ["".join(f"{c:02x}" for c in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = {c: state.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    coded = state.select("vec_id", "label", "components", "code").mapInArrow(
        measure, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    )
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )
