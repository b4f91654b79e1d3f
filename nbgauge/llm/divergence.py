"""Source divergence audit: how far the word use of the sources of a language lies apart.

Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased.  A
language keeps the terms found in at least ``least_docs`` of its documents.  Each group
(language, source), and each language, gives every kept term a smoothed share in
billionths; all arithmetic is on integers.

The sum over all kept terms of the differences of two groups is worked out in a cube of
(group block, group block, term block) cells.  A cell gets the slices of its two group
blocks over its term block, and returns one partial sum per pair of groups; partial
sums are added along the term axis.  A term that a group has not got is not sent: its
share there is the same for all such terms, a number that comes with the group; terms
that both groups of a pair lack are made up for at the end.  A group's slice is copied
once for each group block of its language, and no cell holds more than two blocks of
groups times one block of terms, so neither a source nor a language with most of the
rows makes a large task.

Words are counted in each task before anything is shuffled, in tables of bounded size.

Defined results: a NULL text, language or source is read as ''.  Groups without terms
are there, with the smoothed share of nothing.  A language that keeps no term gives
pairs of value 0 and no terms.  A language with one source has no pairs.  Repeated rows
count again, ids play no part; long texts are counted whole.  Ties go by the UTF-8 bytes
of the item.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nbgauge.llm.common import written

LEAST_DOCS, PRIOR, BILLION = 30, 5, 1_000_000_000
#: Groups and terms of a block, on average: a cell has at most twice the groups.
GROUP_BLOCK, TERM_BLOCK = 64, 512
#: Terms that a task counts before it sends what it has.
HELD_TERMS = 200_000
#: Parts in which the rows of a group meet its totals.
SALTS = 16
TOP_TERMS = 50

# Letters as lower case, bytes of characters beyond ASCII as they are, all else a blank.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_LETTERS).split()


def term_counts(docs: DataFrame, held_terms: int = HELD_TERMS) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each term in each group; each group has a row without a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, found) in held.items():
                words = list(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * (len(words) + 1)), pa.array([source] * (len(words) + 1)), pa.array([w.decode() for w in words] + [None], pa.string()),
                        pa.array([n[w] for w in words] + [0], pa.int64()), pa.array([found[w] for w in words] + [0], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
            held.clear()

        size = 0
        for batch in batches:
            for text, lang, source in zip(*(column.to_pylist() for column in batch.columns)):
                words = Counter(terms(text))
                n, found = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(words)
                found.update(words.keys())
                size += len(n) + 1
                if size > held_terms:
                    yield from rows()
                    size = 0
        yield from rows()

    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    partial = read.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, vocabulary: str) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 V)); decimals, as the product leaves 64 bits."""
    return F.expr(
        f"1L + (CAST({BILLION} AS DECIMAL(10, 0)) * CAST({n} + {PRIOR} AS DECIMAL(19, 0))) div CAST({total} + {PRIOR} * {vocabulary} AS DECIMAL(19, 0))"
    )


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, lang_n of the terms that a language keeps."""
    by_lang = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    return by_lang.where(F.col("docs") >= least_docs).drop("docs")


def group_facts(counts: DataFrame, kept: DataFrame, used: DataFrame) -> DataFrame:
    """lang, source, total, vocabulary, lang_total, n_sources, none (share of an absent term) of every group."""
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("lang_n").alias("lang_total"))
    groups = counts.where("term IS NULL").select("lang", "source")
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("total", "vocabulary", "lang_total")]
    facts = groups.join(totals, ["lang", "source"], "left").join(sources, "lang").join(langs, "lang", "left").select("lang", "source", *zero, "n_sources")
    # A language that keeps nothing has no shares.
    return facts.withColumn("none", F.when(F.col("vocabulary") > 0, share("0L", "total", "greatest(vocabulary, 1L)")).otherwise(F.lit(0).cast("long")))


def priced_terms(used: DataFrame, facts: DataFrame) -> DataFrame:
    """lang, source, term, p, q and the facts of the group, for the kept terms that a group has."""
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = used.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "source", "salt"])
    return rows.select(
        "lang", "source", "term", share("n", "total", "vocabulary").alias("p"), share("lang_n", "lang_total", "vocabulary").alias("q"),
        "none", "vocabulary", "n_sources",
    )


def _blocks(count: str, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(count) / size)).cast("int")


def _bucket(value: str, blocks: str) -> Column:
    return F.expr(f"CAST(pmod(xxhash64({value}), {blocks}) AS INT)")


def cube_cells(priced: DataFrame, facts: DataFrame, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """Rows of all cells: (lang, low, high, slab) is the cell, block tells on which side a row stands; a row without a term brings its group."""
    shape = [_blocks("n_sources", group_block).alias("group_blocks"), _blocks("vocabulary", term_block).alias("term_blocks")]
    own = ["lang", "source", "vocabulary", "none"]
    slices = priced.select(*own, "term", "p", *shape).withColumn("slab", _bucket("term", "term_blocks"))
    # Every group stands in all cells of its block, also where it has no terms.
    groups = facts.select(*own, F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"), *shape)
    groups = groups.withColumn("slab", F.explode(F.expr("sequence(0, term_blocks - 1)")))
    rows = slices.unionByName(groups).withColumn("block", _bucket("source", "group_blocks"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, group_blocks - 1)")))
    return rows.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "slab", "block", "source", "vocabulary", "none", "term", "p")


def _cell(key: tuple, rows: pa.Table) -> pa.Table:
    """Partial sums of the pairs of a cell, over the terms that either group has."""
    lang, low, high, _ = (k.as_py() for k in key)
    with_term = rows["term"].is_valid()
    groups, slices = rows.filter(pa.compute.invert(with_term)), rows.filter(with_term)
    names, block = groups["source"].to_pylist(), groups["block"].to_numpy()
    none = groups["none"].to_numpy()
    vocabulary = groups["vocabulary"][0].as_py() if len(names) else 0
    place = {name: i for i, name in enumerate(names)}
    columns = slices["term"].combine_chunks().dictionary_encode()
    width = len(columns.dictionary) if len(slices) else 0
    table = np.repeat(none[:, None], width, axis=1)
    has = np.zeros((len(names), width), bool)
    if width:
        at = np.array([place[s] for s in slices["source"].to_pylist()]), columns.indices.to_numpy()
        table[at], has[at] = slices["p"].to_numpy(), True
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    out_a, out_b, sums, met = [], [], [], []
    for i in left.tolist():
        others = right if low != high else right[right > i]
        if not len(others):
            continue
        either = has[others] | has[i]
        # Columns that both lack are left to the end, where they are counted over all cells.
        apart = np.abs(table[others] - table[i]) * either
        out_a += [names[i]] * len(others)
        out_b += [names[j] for j in others.tolist()]
        sums.append(apart.sum(axis=1))
        met.append(either.sum(axis=1))
    n = len(out_a)
    spread = {name: value for name, value in zip(names, none.tolist())}
    return pa.table(
        {
            "lang": pa.array([lang] * n, pa.string()), "a": pa.array(out_a, pa.string()), "b": pa.array(out_b, pa.string()),
            "apart": pa.array(np.concatenate(sums) if sums else [], pa.int64()), "met": pa.array(np.concatenate(met) if met else [], pa.int64()),
            "absent": pa.array([abs(spread[x] - spread[y]) for x, y in zip(out_a, out_b)], pa.int64()),
            "vocabulary": pa.array([vocabulary] * n, pa.int64()),
        }
    )


def pair_divergences(cells: DataFrame) -> DataFrame:
    """lang, source, item, value of every ordered pair of sources of a language."""
    partial = cells.groupBy("lang", "low", "high", "slab").applyInArrow(
        _cell, "lang string, a string, b string, apart long, met long, absent long, vocabulary long"
    )
    pairs = partial.groupBy("lang", "a", "b").agg(
        (F.sum("apart") + (F.max("vocabulary") - F.sum("met")) * F.max("absent")).alias("value")
    )
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return pairs.select("lang", F.explode(both).alias("pair"), "value").select("lang", "pair.source", "pair.item", "value")


def ranked(values: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    found = values.withColumn("rank", F.row_number().over(order))
    if most:
        found = found.where(F.col("rank") <= most)
    return found.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources by divergence, and the ``top`` terms a group uses more than its language."""
    counts = written(term_counts(docs), "term-counts")
    kept = written(kept_terms(counts, least_docs), "kept-terms")
    used = written(counts.where("term IS NOT NULL").drop("docs").join(kept, ["lang", "term"]), "used-terms")
    facts = written(group_facts(counts, kept, used), "group-facts")
    priced = written(priced_terms(used, facts), "priced-terms")
    more = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    pairs = pair_divergences(cube_cells(priced, facts, group_block, term_block))
    return ranked(pairs, "pair").unionByName(ranked(more, "term", top))
