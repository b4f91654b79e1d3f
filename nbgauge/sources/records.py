"""CSV records from files that many tasks read at once.

A line break inside quotes does not end a record, and whether a split of a file begins
inside quotes depends on all that stands before it.  So each split first answers where it
would end, had it begun outside or inside quotes; a window over the splits of a file (a
row each) chains these answers; then every split cuts its lines into records.  A record
that reaches over the end of a split is put together from its pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nbgauge.session import cut_lineage

#: Splits of a table; a row of about a hundred bytes each is shipped to the tasks.
MAX_SPLITS = 2_000_000

_WHOLE, _TAIL, _HEAD, _MIDDLE = range(4)


def ends_inside(line: str, inside: bool, separator: str = ",") -> bool:
    """Whether a line that begins outside or inside quotes ends inside them."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            # A field in quotes begins with one; quotes further on in a field are part of it.
            if line[at : at + 1] != '"':
                comma = line.find(separator, at)
                if comma < 0:
                    return False
                at = comma + 1
                continue
            at += 1
        inside = False
        quote = line.find('"', at)
        while quote >= 0 and line[quote + 1 : quote + 2] == '"':
            quote = line.find('"', quote + 2)
        if quote < 0:
            return True
        comma = line.find(separator, quote + 1)
        if comma < 0:
            return False
        at = comma + 1


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, start: the lines of all files in their order, and the split that each was read in."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _runs(batches: Iterator[pa.RecordBatch], at: int = 1) -> Iterator[tuple[tuple, list[str], list]]:
    """Neighbouring lines of one split, with the columns after the split's."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        keys = list(zip(columns[at], columns[at + 1]))
        begin = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[begin]:
                yield keys[begin], columns[0][begin:i], [c[begin] for c in columns[at + 2 :]]
                begin = i


def split_states(lines: DataFrame, separator: str = ",") -> DataFrame:
    """file, start, inside, returns: whether each split begins inside quotes, and whether the file's lines end with carriage returns (as its first one does)."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[bool]] = {}
        for key, texts, _ in _runs(batches):
            ends = found.get(key)
            if ends is None:
                ends = found[key] = [False, True, key[1] == 0 and texts[0].endswith("\r")]
            for line in texts:
                if '"' in line:
                    ends[:2] = [ends_inside(line, end, separator) for end in ends[:2]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()), *[pa.array([e[i] for e in found.values()], pa.bool_()) for i in range(3)]],
            names=["file", "start", "end_if_out", "end_if_in", "returns"],
        )

    splits = lines.mapInArrow(answer, "file string, start long, end_if_out boolean, end_if_in boolean, returns boolean")
    # What lies before a split: the last one whose end does not depend on its beginning, then those that turn it round.
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("end_if_out") == F.col("end_if_in")
    turns = (F.col("end_if_out") & ~F.col("end_if_in")).cast("long")
    summed = splits.withColumn("turns", F.coalesce(F.sum(turns).over(order), F.lit(0)))
    known = F.last(F.when(fixed, F.struct("end_if_out", "turns")), ignorenulls=True).over(before)
    count = F.coalesce(F.lag("turns").over(order), F.lit(0)) - F.coalesce(known["turns"], F.lit(0))
    inside = F.coalesce(known["end_if_out"], F.lit(False)) != (count % 2 == 1)
    return summed.select("file", "start", inside.alias("inside"), F.max("returns").over(Window.partitionBy("file")).alias("returns"))


def _cut(separator: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, inside, held, head = None, False, [], False
        rows: list[tuple] = []

        def close() -> None:
            """End of a split: what is still open goes on in the next one."""
            if held:
                rows.append((*split, (_MIDDLE if head else _TAIL), False, "\n".join(held)))
                held.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "start", "piece", "is_first", "record"])
            rows.clear()
            return batch

        first = False
        for key, texts, (begins_inside, returns) in _runs(batches):
            if key != split:
                close()
                if begins_inside is None:
                    raise ValueError(f"the splits of {key[0]} changed while it was read")
                split, inside, head, first = key, begins_inside, begins_inside, key[1] == 0
            for line in texts:
                if returns and line.endswith("\r"):
                    line = line[:-1]
                held.append(line)
                inside = ends_inside(line, inside, separator)
                if not inside:
                    record = held[0] if len(held) == 1 else "\n".join(held)
                    rows.append((*split, _HEAD if head else _WHOLE, first, record))
                    held.clear()
                    head = first = False
            # A record that is open is the first one only if none was closed.
            if rows:
                yield flush()
        if held and first:
            rows.append((*split, _TAIL, True, "\n".join(held)))
            held.clear()
        close()
        yield flush()

    return cut


def csv_records(spark: SparkSession, path: str, separator: str = ",", header: bool = True) -> DataFrame:
    """record: the text of each record but the empty ones and, with ``header``, the first of each file."""
    lines = text_lines(spark, path)
    states = cut_lineage(split_states(lines, separator))
    if states.count() > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits; raise spark.sql.files.maxPartitionBytes")
    # Joined from a broadcast (checked above), so lines stay in their order.
    told = lines.join(F.broadcast(states), ["file", "start"], "left").select("value", "file", "start", "inside", "returns")
    pieces = told.mapInArrow(_cut(separator), "file string, start long, piece int, is_first boolean, record string")
    # At most two pieces per split; a record's number is that of the tail that opens it.
    parts = cut_lineage(pieces.where(F.col("piece") != _WHOLE))
    # A split's head closes the record open before it; its tail opens the next one.
    rank = F.when(F.col("piece") == _TAIL, 1).otherwise(0)
    order = Window.partitionBy("file").orderBy("start", rank)
    numbered = parts.withColumn("number", F.sum(rank).over(order)).withColumn("rank", rank)
    sewn = numbered.groupBy("file", "number").agg(
        F.sort_array(F.collect_list(F.struct("start", "rank", "record"))).alias("all"), F.max("is_first").alias("is_first")
    ).select("is_first", F.array_join(F.transform("all", lambda x: x["record"]), "\n").alias("record"))
    records = pieces.where(F.col("piece") == _WHOLE).select("is_first", "record").unionByName(sewn)
    if header:
        records = records.where(~F.col("is_first"))
    return records.select("record").where("record <> ''")
