"""Cells that are delivered again: repeats are dropped, changed ones corrected.

A notebook's cells are kept in a state, a version each.  A cell that comes again with
other content and a later time replaces the one known and is handed on as a correction;
the same content, or a version older than the one known, is not.  What is known of a cell
is let go once the stream is ``keep`` past it, also if nothing more comes of its notebook.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Cells of one state; a longer notebook has several.
CELLS_PER_STATE = 1_000


def _versions(columns: list[str], time_col: str, keep_ms: int):
    """Function of the new rows of a state that gives the changes among them."""

    def take(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known: dict[int, tuple[int, int]] = {}
        if state.exists:
            known = {index: (digest, at) for index, digest, at in zip(*state.get)}
        changes = []
        if not state.hasTimedOut:
            cells = pd.concat(list(frames), ignore_index=True).sort_values(["cell_index", time_col, "_digest"], kind="stable")
            times = cells[time_col].astype("datetime64[us]").astype("int64") // 1000
            for row, (index, digest, at) in enumerate(zip(cells["cell_index"].tolist(), cells["_digest"].tolist(), times.tolist())):
                before = known.get(index)
                change = "new" if before is None else "changed" if digest != before[0] and at > before[1] else None
                if change or at > before[1]:
                    # The same content at a later time is known for longer.
                    known[index] = (digest, at)
                if change:
                    changes.append((row, change))
        past = state.getCurrentWatermarkMs() - keep_ms
        known = {index: (digest, at) for index, (digest, at) in known.items() if at > past}
        if known:
            order = sorted(known)
            state.update((order, [known[i][0] for i in order], [known[i][1] for i in order]))
            state.setTimeoutTimestamp(min(at for _, at in known.values()) + keep_ms + 1)
        else:
            state.remove()
        if changes:
            out = cells.iloc[[row for row, _ in changes]][columns].copy()
            out["change"] = [change for _, change in changes]
            yield out

    return take


def corrected_cells(cells: DataFrame, time_col: str, keep: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """All columns of the cells with ``change``: ``new`` or ``changed``.  Rows may come ``delay`` late, later ones are dropped."""
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    content = [F.col(c) for c, kind in cells.dtypes if c not in ("kernel_id", "cell_index", time_col) and "map<" not in kind]
    keyed = cells.withColumns({"_digest": F.xxhash64(*content), "_run": F.floor(F.col("cell_index") / CELLS_PER_STATE).cast("int")})
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in cells.dtypes)
    return keyed.withWatermark(time_col, delay).groupBy("kernel_id", "_run").applyInPandasWithState(
        _versions(cells.columns, time_col, keep_ms), f"{kinds}, change string", "indexes array<int>, digests array<long>, times array<long>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )


def stream_corrections(cells: DataFrame, time_col: str, target: str, checkpoint: str, **options) -> StreamingQuery:
    """Append new and corrected cells to a table, a folder per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch that is run again writes the same folder again.
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    changes = corrected_cells(cells, time_col, **options)
    return changes.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_cells(spark: SparkSession, target: str, time_col: str) -> DataFrame:
    """The latest version of each cell, combined before the only shuffle."""
    rows = spark.read.parquet(target)
    columns = [c for c in rows.columns if c not in ("change", "batch")]
    latest = rows.groupBy("kernel_id", "cell_index").agg(F.max_by(F.struct(*columns), F.struct(F.col(time_col), "batch")).alias("v"))
    return latest.select("v.*")
