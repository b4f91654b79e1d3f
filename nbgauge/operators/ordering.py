"""Exact ranks, cuts, top-k, samples and splits over tables of any size.

A window ordered over the whole table, or a large ``limit``, ends in one task.
For the rank of every row the sort keys are range-partitioned and sorted; a position
inside a partition plus the sizes of the partitions before it is the exact rank.  A
cut needs a few keys only: they are found by counting, and the rows are then picked
by comparing with them.  Only rows that share the key of a cut are told apart
further, by a hash of the row and then by number.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nbgauge.session import cut_lineage

_POSITION_BITS = 33  # layout of monotonically_increasing_id


def sort_keys(*columns: str | Column) -> dict[str, Column]:
    """Sort keys of the columns, NULL last."""
    keys: dict[str, Column] = {}
    for i, column in enumerate(columns):
        value = F.col(column) if isinstance(column, str) else column
        keys[f"_n{i}"] = value.isNull()
        keys[f"_k{i}"] = value
    return keys


def row_hash(df: DataFrame) -> Column:
    """Hash of all columns that can be hashed (maps cannot)."""
    return F.xxhash64(*[F.col(f"`{name}`") for name, kind in df.dtypes if "map<" not in kind and kind != "variant"])


def with_global_rank(df: DataFrame, *columns: str, rank: str = "rank") -> DataFrame:
    """Add the 1-based rank of each row in the order of ``columns`` (NULL last), then of a hash of the row."""
    names = df.columns
    keys = {**sort_keys(*columns), "_h": row_hash(df)}
    return _ranked(df.withColumns(keys), list(keys), rank).select(*names, rank)


def _ranked(df: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    # The written rows fix which row lies in which partition, so the sizes and
    # the positions below agree even if executors are lost in between.
    placed = cut_lineage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", _POSITION_BITS))
    # One row per partition; the window below runs over these only.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    # Bounded by the number of partitions.
    joined = placed.join(F.broadcast(offsets), "_part")
    return joined.withColumn(rank, F.col("_before") + inside + 1)


class RankCuts:
    """Cuts a table at chosen ranks; every part gets exactly its number of rows.

    The keys at the ranks are found by narrowing: approximate quantiles give two values
    around a rank, exact counts tell where the rank lies, and so on among the rows
    between, until they are few enough to be looked at.  Each step reads the key columns
    and returns a few numbers; no rows are sorted or moved.

    The table is read several times, so it must give equal rows each time: a written
    table, or one whose scores do not depend on the order of a sum.
    """

    def __init__(self, df: DataFrame, *columns: str | Column):
        self.df = df
        self._keys = sort_keys(*columns)
        self._keyed = df.select(*[c.alias(k) for k, c in self._keys.items()])
        self.size = self._keyed.count()

    def cut(self, *ends: int, column: str = "_run") -> DataFrame:
        """Add the number of the run a row lies in: 0 up to rank ``ends[0]``, then 1 up to ``ends[1]``, and so on."""
        inner = sorted({e for e in ends if 0 < e < self.size})
        # Two rows per cut: the last before it and the first after it.
        found = keys_at_ranks(self._keyed, self.size, {*inner, *(e + 1 for e in inner)})
        here = F.struct(*[c.alias(k) for k, c in self._keys.items()])
        walls = {e: self._wall(found[e]) for e in inner}
        run = F.lit(sum(e < 1 for e in ends)).cast("int")
        for e in ends:
            if e in walls:
                run = run + (here > walls[e]).cast("int")
        # Where both rows at a cut have one key, its rows are told apart by their hash.
        tied = {repr(found[e]): walls[e] for e in inner if repr(found[e]) == repr(found[e + 1])}
        result = self.df.withColumn(column, run)
        for wall in tied.values():
            result = result.where(here != wall)
        for key, wall in tied.items():
            before = self._keyed.where(F.struct(*self._keys) < wall).count()
            rows = self.df.where(here == wall)
            inside = [e - before for e in ends]
            result = result.unionByName(self._cut_tied(rows, inside, column))
        return result

    def _cut_tied(self, rows: DataFrame, ends: list[int], column: str) -> DataFrame:
        """Rows of one key, cut by their hash; rows that share a hash too are numbered."""
        if self._hashed:
            numbered = _ranked(rows.withColumn("_salt", F.monotonically_increasing_id()), ["_salt"], "_rank")
            run = sum(((F.col("_rank") > e).cast("int") for e in ends), F.lit(0))
            return numbered.select(*self.df.columns, run.cast("int").alias(column))
        inner = RankCuts(rows, row_hash(rows))
        inner._hashed = True
        return inner.cut(*ends, column=column)

    #: Whether the key is the hash of the row already.
    _hashed = False

    def _wall(self, key: tuple) -> Column:
        types = {f.name: f.dataType for f in self._keyed.schema}
        return F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in zip(self._keys, key)])

    def first(self, n: int) -> DataFrame:
        """The first ``n`` rows."""
        return self.cut(n).where(F.col("_run") == 0).drop("_run")

    def last(self, n: int) -> DataFrame:
        """The last ``n`` rows."""
        return self.cut(self.size - n).where(F.col("_run") == 1).drop("_run")


#: Keys that are looked at one by one, and the share of the rows on either side of a rank that quantiles leave.
FEW_KEYS, BAND = 20_000, 1e-4


def key_words(column: Column, kind: T.DataType, place: int) -> Column | None:
    """Number ``place`` of those that order a value: one for numbers and times, one per six bytes of a text; None behind the last.

    Numbers are doubles as long as those are exact, so long integers are two.
    """
    if isinstance(kind, T.StringType):
        piece = F.substring(F.encode(column, "UTF-8"), 6 * place + 1, 6)
        return F.conv(F.rpad(F.hex(piece), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        # NaN stands behind infinity.
        value = column.cast("double")
        return (F.when(F.isnan(value), F.lit(float("inf"))).otherwise(value), F.isnan(value).cast("double"))[place] if place < 2 else None
    if isinstance(kind, T.DecimalType):
        # Rounding keeps the order; what is rounded to one double is told apart by the rest.
        return column.cast("double") if place == 0 else (column - column.cast("double").cast(kind)).cast("double") if place == 1 else None
    if isinstance(kind, T.BooleanType):
        return column.cast("int").cast("double") if place == 0 else None
    if isinstance(kind, T.DateType):
        whole = F.unix_date(column).cast("long")
    elif isinstance(kind, T.TimestampType):
        whole = F.unix_micros(column)
    elif isinstance(kind, T.IntegralType):
        whole = column.cast("long")
    else:
        raise TypeError(f"no ranks over {kind.simpleString()}")
    return (F.shiftright(whole, 32).cast("double"), whole.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double"))[place] if place < 2 else None


class _Search:
    """One rank: the rows it lies among (a predicate), its place among them, and the word that is compared next."""

    def __init__(self, rank: int, size: int):
        self.rank, self.size, self.among, self.column, self.place = rank, size, F.lit(True), 0, 0


def keys_at_ranks(keyed: DataFrame, size: int, ranks: Iterable[int]) -> dict[int, tuple]:
    """The keys of the rows at 1-based ranks, in the order of all columns.  NaN is the greatest number."""
    searches = {r: _Search(r, size) for r in sorted(ranks)}
    fields = keyed.schema.fields
    order = [F.col(f.name).asc_nulls_last() for f in fields]
    longest: dict[str, int] = {}
    if size > FEW_KEYS:
        # Marks that no row has need not be asked for.
        marks = [f.name for f in fields if isinstance(f.dataType, T.BooleanType)]
        met = keyed.agg(*[F.coalesce(F.bool_or(m), F.lit(False)).alias(m) for m in marks]).first().asDict() if marks else {}
        fields = [f for f in fields if met.get(f.name, True)]

    def word(s: _Search) -> Column | None:
        field = fields[s.column]
        if isinstance(field.dataType, T.StringType) and s.place:
            if field.name not in longest:
                longest[field.name] = keyed.agg(F.max(F.octet_length(field.name))).first()[0] or 0
            # Behind the last byte only the length differs: zero bytes at the end of a text.
            if 6 * s.place >= longest[field.name]:
                return F.octet_length(field.name).cast("double") if 6 * (s.place - 1) < longest[field.name] else None
        return key_words(F.col(field.name), field.dataType, s.place)

    while open_ := [s for s in searches.values() if s.size > FEW_KEYS and s.column < len(fields)]:
        steps = []
        for s in open_:
            value = word(s)
            while value is None and s.column + 1 < len(fields):
                s.column, s.place = s.column + 1, 0
                value = word(s)
            if value is None:
                # All columns are the same for these rows.
                s.column = len(fields)
            else:
                steps.append((s, value))
        if not steps:
            continue
        around = [
            F.percentile_approx(F.when(s.among, v), [max(0.0, s.rank / s.size - BAND), min(1.0, s.rank / s.size + BAND)], 20_000).alias(f"q{i}")
            for i, (s, v) in enumerate(steps)
        ]
        bounds = list(keyed.agg(*around).first())
        counts = []
        for (s, v), found in zip(steps, bounds):
            # A NULL word belongs to a column that is NULL in all these rows.
            low, high = found or (None, None)
            parts = [v < low, v == low, (v > low) & (v < high), v == high] if found else []
            counts += [F.count_if(s.among & p) for p in parts]
        exact = iter(keyed.agg(*counts).first() if counts else ())
        for (s, v), found in zip(steps, bounds):
            if not found:
                s.column, s.place = s.column + 1, 0
                continue
            low, high = found
            below, at_low, between, at_high = (next(exact) for _ in range(4))
            if low == high:
                between, at_high = 0, 0
            parts = [(v < low, below, False), (v == low, at_low, True), ((v > low) & (v < high), between, False), (v == high, at_high, True)]
            parts.append((v > high, s.size - below - at_low - between - at_high, False))
            for part, n, same in parts:
                if s.rank <= n:
                    s.among, s.size = s.among & part, n
                    if same:
                        s.place += 1
                    break
                s.rank -= n
    out = {}
    for r, s in searches.items():
        few = keyed.where(s.among)
        # FEW_KEYS at most, or rows of one key.
        few = few.orderBy(*order).offset(s.rank - 1) if s.column < len(fields) else few
        out[r] = tuple(few.limit(1).collect()[0])
    return out


def sorted_by(df: DataFrame, score: str, id_col: str = "KernelId") -> DataFrame:
    """Global order by a score, NULL last, ties by id."""
    return df.orderBy(F.col(score).asc_nulls_last(), F.col(id_col))


def lowest(df: DataFrame, n: int, *columns: str | Column) -> DataFrame:
    """The first ``n`` rows in the order of ``columns``."""
    return RankCuts(df, *columns).first(n)


def extreme_sizes(rows: int, split_factor: float = 0.7, selection_ratio: float = 0.25) -> tuple[int, int]:
    """How many of the worst and of the best rows are selected."""
    return int(selection_ratio * split_factor * rows), int(selection_ratio * (1 - split_factor) * rows)


def select_extremes(
    df: DataFrame,
    score: str = "combined_score",
    split_factor: float = 0.7,
    selection_ratio: float = 0.25,
    id_col: str = "KernelId",
) -> DataFrame:
    """The worst rows with label 0 and the best with label 1; the middle is left out."""
    cuts = RankCuts(df, score, id_col)
    worst, best = extreme_sizes(cuts.size, split_factor, selection_ratio)
    return _label_ends(cuts, worst, best)


def select_symmetric(df: DataFrame, fraction: float = 0.10, score: str = "combined_score", id_col: str = "KernelId"):
    """The same share from both ends."""
    cuts = RankCuts(df, score, id_col)
    n = int(fraction * cuts.size)
    return _label_ends(cuts, n, n)


def head_and_tail(df: DataFrame, k: int, score: str = "score", id_col: str = "KernelId") -> DataFrame:
    """The ``k`` first and the ``k`` last rows by score; short tables give rows twice."""
    cuts = RankCuts(df, score, id_col)
    return cuts.first(k).unionByName(cuts.last(k))


def _label_ends(cuts: RankCuts, worst: int, best: int) -> DataFrame:
    ends = cuts.cut(worst, max(worst, cuts.size - best))
    return ends.where("_run <> 1").withColumn("label", F.when(F.col("_run") == 0, 0).otherwise(1)).drop("_run")


def split_at_rank(
    df: DataFrame, score: str, fraction: float = 0.5, label: str = "label", id_col: str = "KernelId"
) -> DataFrame:
    """Label 0 for the lowest share of the rows, 1 for the rest."""
    cuts = RankCuts(df, score, id_col)
    halves = cuts.cut(int(fraction * cuts.size))
    return halves.withColumn(label, F.when(F.col("_run") == 0, 0).otherwise(1)).drop("_run")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def balanced_head(df: DataFrame, label: str = "expert_score", id_col: str = "KernelId", classes=(0, 1)) -> DataFrame:
    """As many rows of each class as the smaller class has, in the order of the id.

    The smaller class is kept whole; a cut key is searched for larger ones.
    """
    counts = {r[label]: r["n"] for r in class_counts(df.where(F.col(label).isin(*classes)), label).collect()}
    size = min(counts.get(c, 0) for c in classes)
    parts = []
    for c in classes:
        rows = df.where(F.col(label) == c)
        parts.append(rows if counts.get(c, 0) == size else lowest(rows, size, id_col))
    result = parts[0]
    for rows in parts[1:]:
        result = result.unionByName(rows)
    return result


def _shuffled(id_col: str, seed: int) -> Column:
    """Random order of ids that any engine can repeat."""
    return F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), F.lit(16))


def sample_rows(df: DataFrame, n: int, id_col: str = "KernelId", seed: int = 42) -> DataFrame:
    """``n`` rows at random, the same for the same seed."""
    return lowest(df, n, _shuffled(id_col, seed), id_col)


def first_rows(df: DataFrame, other: DataFrame, id_col: str = "KernelId") -> DataFrame:
    """Cut to the length of another table."""
    return lowest(df, other.count(), id_col)


def random_split(
    df: DataFrame, fraction: float = 0.1, id_col: str = "KernelId", seed: int = 42, name: str = "test", rest: str = "train"
) -> DataFrame:
    """Add ``split``: ceil(fraction * rows) rows at random are ``name``, the others ``rest``."""
    cuts = RankCuts(df, _shuffled(id_col, seed), id_col)
    parts = cuts.cut(math.ceil(fraction * cuts.size))
    return parts.withColumn("split", F.when(F.col("_run") == 0, F.lit(name)).otherwise(F.lit(rest))).drop("_run")


def three_way_split(
    df: DataFrame, eval_fraction: float = 0.13, test_fraction: float = 0.25, id_col: str = "KernelId", seed: int = 1
) -> DataFrame:
    """Add ``split``: ``eval`` first, then ``test`` from the rest, else ``train``."""
    outer = random_split(df, eval_fraction, id_col, seed, "eval", "train")
    rest = outer.where(F.col("split") == "train").drop("split")
    inner = random_split(rest, test_fraction, id_col, seed + 1)
    return outer.where(F.col("split") == "eval").unionByName(inner)


def union_labelled(parts: Iterable[tuple[DataFrame, int]], label: str = "label") -> DataFrame:
    """All rows of several tables, each with its label."""
    labelled = [df.withColumn(label, F.lit(value)) for df, value in parts]
    result = labelled[0]
    for df in labelled[1:]:
        result = result.unionByName(df)
    return result
