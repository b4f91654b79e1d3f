"""Best-fit packing of documents into bins under conflicts.

Bins hold up to ``capacity`` words.  Two pieces conflict if they come from one
source or from one duplicate cluster; no bin holds a conflict.  A task keeps its
bins ordered by what is left in them, with a bitmap of sources and one of
clusters each; the search starts at the tightest bin that has room and goes on to
its successors until one is compatible, else a new bin is opened.

Documents are dealt to packing groups of bounded size by a hash, so a group is a
small task whatever the sources are.  Texts are not moved: pieces are sizes.

Defined results: a document longer than a bin is cut into full bins and a rest.
NULL, empty and blank texts have one piece of no words.  A NULL source conflicts
with none; a missing cluster column means equal texts are clusters.  Repeated
rows are packed each; the copies are clusters, so they part.  Ties go to longer
pieces, then smaller ids.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Equal rows that go to one packing group together.
COPIES = 16
_NO_WORDS = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words as runs of anything but space, tab and line ends."""
    value = F.coalesce(text.cast("string"), F.lit(""))
    return F.regexp_count(value, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def pack(items: Iterable[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """Bin and place in it of each (size, source, cluster), in the order given.

    Sources and clusters are small numbers, -1 for none.  Sizes do not exceed the capacity.
    """
    residuals: list[tuple[int, int]] = []  # what is left, bin
    sources: list[int] = []
    clusters: list[int] = []
    filled: list[int] = []
    places = []
    for size, source, cluster in items:
        source_bit = 1 << source if source >= 0 else 0
        cluster_bit = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(residuals, (size, -1))
        while at < len(residuals):
            number = residuals[at][1]
            if not (sources[number] & source_bit or clusters[number] & cluster_bit):
                break
            at += 1
        if at < len(residuals):
            left, number = residuals.pop(at)
        else:
            left, number = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
            filled.append(0)
        sources[number] |= source_bit
        clusters[number] |= cluster_bit
        places.append((number, filled[number]))
        filled[number] += size
        insort(residuals, (left - size, number))
    return places


def best_fit(
    docs: DataFrame, capacity: int = 4096, group_rows: int = 1000, source: str = "source", cluster: str | None = None
) -> DataFrame:
    """One row per piece: doc_id, piece, first_word, n_words, bin, bin_offset.

    ``cluster`` names a column of duplicate clusters; without it equal texts form one.
    """
    text = F.col("text").cast("string")
    cluster_key = F.xxhash64(F.col(cluster).cast("string")) if cluster else F.xxhash64(text)
    unknown = F.col(cluster).isNull() if cluster else text.isNull()
    sized = docs.select(
        "doc_id", word_count(text).alias("words"), F.xxhash64(F.col(source).cast("string")).alias("source_key"),
        F.col(source).isNull().alias("no_source"), cluster_key.alias("cluster_key"), unknown.alias("no_cluster"),
    )
    # Rows equal in all that packing looks at are counted and dealt out COPIES at a time, so bins do not depend on the table's partitions.
    counted = sized.groupBy(*sized.columns).count()
    blocks = counted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(count - 1) div {COPIES}"))))
    blocks = blocks.withColumn("copies", F.least(F.lit(COPIES), F.col("count") - F.col("salt") * COPIES)).drop("count")
    groups = max(1, -(-docs.select("doc_id").count() // group_rows))
    dealt = blocks.withColumn("packing_group", F.pmod(F.xxhash64("doc_id", "cluster_key", "salt"), F.lit(groups)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "cluster_key", "source_key", "words", "salt"], kind="stable")
        rows = rows.loc[rows.index.repeat(rows["copies"])].reset_index(drop=True)
        words = rows["words"].to_numpy(np.int64)
        pieces = np.maximum(1, -(-words // capacity))
        owner = np.repeat(np.arange(len(rows)), pieces)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(words[owner] - piece * capacity, capacity)
        source_code = np.where(rows["no_source"], -1, pd.factorize(rows["source_key"])[0])[owner]
        cluster_code = np.where(rows["no_cluster"], -1, pd.factorize(rows["cluster_key"])[0])[owner]
        order = np.argsort(-size, kind="stable")
        found = pack(zip(size[order].tolist(), source_code[order].tolist(), cluster_code[order].tolist()), capacity)
        bins, offsets = np.empty(len(owner), np.int64), np.empty(len(owner), np.int64)
        for at, (number, offset) in zip(order, found):
            bins[at], offsets[at] = number, offset
        # A bin's number: its group, then 24 bits for the place among the group's bins.
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"].to_numpy()[owner] if not rows["doc_id"].isna().any() else rows["doc_id"].astype(object).where(rows["doc_id"].notna(), None).iloc[owner].to_numpy(),
                "piece": piece.astype(np.int32), "first_word": piece * capacity, "n_words": size,
                "bin": (int(key[0]) << 24) + bins, "bin_offset": offsets,
            }
        )

    return dealt.groupBy("packing_group").applyInPandas(
        place, f"doc_id {kind}, piece int, first_word long, n_words long, bin long, bin_offset long"
    )
