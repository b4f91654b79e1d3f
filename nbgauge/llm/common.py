"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nbgauge.session import shared_dir

FOLDS = 3
HELD_OUT_FOLD = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, as a Parquet table of the shared folder, and read back."""
    target = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def fold(id_col: str = "doc_id") -> Column:
    """Fold of a document, from its id alone; NULL for a NULL id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(fold(id_col) == HELD_OUT_FOLD, F.lit(False))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` has not got in any spelling."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def text_function(score: Callable[[list], pa.Array], return_type: str, rows: int = 2000):
    """A column function over whole texts.

    ``score`` gets up to ``rows`` texts (or None) at a time, so that what it
    builds per batch stays small.
    """

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [score(texts.slice(i, rows).to_pylist()) for i in range(0, len(texts), rows)]
            yield pa.concat_arrays(parts) if parts else score([])

    apply.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(apply, return_type)


def smallest_hashes(ids: DataFrame, n: int) -> DataFrame:
    """At most ``n`` distinct ids, those with the smallest hashes: the same ones in each run."""
    return ids.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
