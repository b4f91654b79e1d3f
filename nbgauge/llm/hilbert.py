"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is cut into equally full cells; the cells of a row are a point,
and its index on the Hilbert curve orders the rows.  Runs of that order are the
shards: neighbours on the curve are near in all dimensions, so a file's ranges
of values stay narrow and filters on any of them skip files.  All on DataFrame
functions.

Defined results: NULL has a cell of its own, before all values.  Rows with one
index are ordered by the hash of their text and their id, so equal texts lie
side by side; rows equal in all of that, however many, are spread over
partitions and numbered in some order.  Long texts are hashed whole, and only their
hash is sorted.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nbgauge.llm.common import quoted
from nbgauge.operators.ordering import with_global_rank
from nbgauge.session import cut_lineage

#: Distinct values of a text that one task sums in order.
WALL_VALUES = 100_000


def sort_value(df: DataFrame, column: str) -> Column:
    """A number in the order of the values; a text is itself."""
    kind = df.schema[column].dataType
    value = quoted(column)
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return F.unix_timestamp(value)
    return value.cast("double")


def text_walls(df: DataFrame, value: Column, walls: int) -> list[str]:
    """Whole texts that cut the rows into equally full cells.

    All distinct values are counted and dealt into ranges; the rows before a range tell
    which ranges hold a wall, and only there the values are summed in order.
    """
    counted = df.select(value.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("rows"))
    counted = cut_lineage(counted)
    ranges = max(1, -(-counted.count() // WALL_VALUES))
    # Written once, so that the ranges and their sums belong together.
    placed = cut_lineage(counted.repartitionByRange(ranges, "value").withColumn("part", F.spark_partition_id())) if ranges > 1 else counted.withColumn("part", F.lit(0))
    # A number per range comes back.
    sizes = placed.groupBy("part").agg(F.sum("rows").alias("rows")).orderBy("part").collect()
    total = float(sum(r["rows"] for r in sizes))
    shares = [(i + 1) / (walls + 1) for i in range(walls)]
    before, holding = 0, []
    for part, rows in sizes:
        if any(before / total < s <= (before + rows) / total for s in shares):
            holding.append((part, before))
        before += rows
    if not holding:
        return []
    starts = df.sparkSession.createDataFrame(holding, "part int, before long")
    inside = Window.partitionBy("part").orderBy("value")
    summed = placed.join(F.broadcast(starts), "part").withColumn("upto", F.col("before") + F.sum("rows").over(inside))
    first, last = (F.col("upto") - F.col("rows")) / F.lit(total), F.col("upto") / F.lit(total)
    found = summed.select("value", F.explode(F.filter(F.array(*[F.lit(s) for s in shares]), lambda s: (s > first) & (s <= last))).alias("share"))
    return [r["value"] for r in found.orderBy("share").collect()]


def cells(df: DataFrame, dimensions: Sequence[str], bits: int) -> list[Column]:
    """Cell (0 to 2^bits - 1) of each dimension, equally full by approximate quantiles."""
    values = [sort_value(df, d) for d in dimensions]
    texts = [isinstance(df.schema[d].dataType, T.StringType) for d in dimensions]
    walls = (1 << bits) - 2
    shares = F.array(*[F.lit((i + 1) / (walls + 1)) for i in range(walls)])
    # 2^bits numbers or texts per dimension come back, whatever the table.
    numbers = [F.percentile_approx(v, shares, 10_000).alias(f"b{i}") for i, v in enumerate(values) if not texts[i]]
    facts = df.agg(*numbers).first() if numbers else {}
    bounds = [text_walls(df, v, walls) if texts[i] else facts[f"b{i}"] for i, v in enumerate(values)]
    out = []
    for value, found in zip(values, bounds):
        # Bounds repeat where a value fills several cells, so few values still spread over all cells.
        fixed = F.array(*[F.lit(b) for b in found]) if found else None
        above = F.size(F.filter(fixed, _below(value))) if found else F.lit(0)
        out.append(F.when(value.isNull(), F.lit(0)).otherwise(above + 1).cast("int"))
    return out


def _below(value: Column):
    return lambda bound: bound < value


def hilbert_steps(point: Column, dimensions: int, bits: int) -> Column:
    """Undo the curve's turns: axes to its transposed index, before the Gray code (after J. Skilling, 2004)."""
    turns = [(1 << b) * dimensions + i for b in range(bits - 1, 0, -1) for i in range(dimensions)]
    if not turns:
        return point

    def step(x: Column, turn: Column) -> Column:
        level, axis = F.floor(turn / dimensions).cast("int"), (turn % dimensions).cast("int")
        low = level - 1
        here = F.element_at(x, axis + 1)
        swap = F.element_at(x, 1).bitwiseXOR(here).bitwiseAND(low)
        flip = here.bitwiseAND(level) != 0

        def moved(value: Column, j: Column) -> Column:
            return (
                F.when(flip & (j == 0), value.bitwiseXOR(low))
                .when(~flip & ((j == 0) | (j == axis)) & (axis != 0), value.bitwiseXOR(swap))
                .otherwise(value)
            )

        return F.transform(x, moved)

    return F.reduce(F.array(*[F.lit(t) for t in turns]), point, step)


def with_hilbert_index(df: DataFrame, points: Sequence[Column], bits: int, column: str = "hilbert") -> DataFrame:
    """Add the index of a point (ints below 2^bits) on the Hilbert curve."""
    n = len(points)
    if n * bits > 62:
        raise ValueError("index does not fit a long")
    df = df.withColumn("_x", F.array(*points)).withColumn("_x", hilbert_steps(F.col("_x"), n, bits))
    prefix = F.col("_x")[0]
    gray = [prefix]
    for i in range(1, n):
        prefix = prefix.bitwiseXOR(F.col("_x")[i])
        gray.append(prefix)
    df = df.withColumn("_x", F.array(*gray))
    last = F.col("_x")[n - 1]
    turn = F.lit(0)
    for b in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(last.bitwiseAND(1 << b) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
    df = df.withColumn("_x", F.transform(F.col("_x"), lambda v: v.bitwiseXOR(turn)))
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(F.col("_x")[i], b).bitwiseAND(1).cast("long"))
    return df.withColumn(column, index).drop("_x")


def hilbert_shards(
    docs: DataFrame, dimensions: Sequence[str] = ("source", "lang", "n_chars"), shards: int = 40, bits: int = 5
) -> DataFrame:
    """Place every document: shard and slot along the curve, numbers of rows at most one apart.

    The texts are hashed where they are read; only ids, sizes and indexes are sorted.
    """
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16
    points = cells(docs, dimensions, bits)
    names = [f"cell_{i}" for i in range(len(dimensions))]
    narrow = docs.select(
        "doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[p.alias(c) for p, c in zip(points, names)]
    )
    placed = with_hilbert_index(narrow, [F.col(c) for c in names], bits).withColumn("salt", F.monotonically_increasing_id())
    # Ranking reads its rows more than once; the texts are read and hashed once.
    placed = cut_lineage(placed)
    ranked = with_global_rank(placed, "hilbert", "text_crc32", "doc_id", "salt")
    rows = ranked.count()
    if rows == 0:
        rows = 1
    shard = F.expr(f"(rank - 1) * {shards} div {rows}")
    first = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - 1 - first)
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "hilbert", *names,
        )
    )


def zone_map(placed: DataFrame, columns: Sequence[str], shard: str = "shard") -> DataFrame:
    """Least and greatest value of each column per shard: what a reader needs to skip files."""
    return placed.groupBy(shard).agg(
        F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    )
