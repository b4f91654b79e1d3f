"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, everything else a lower-case
word without its punctuation.  Windows of the documents' templates are looked up
in the hashed windows of the benchmark's; a document that holds most windows of
an item is then checked slot by slot: what stands for one value of the item must
be one value throughout, so that a question with other numbers or names is
caught while chance meetings of placeholders are not.

Windows come in three forms: with names as placeholders; with names as words, so
that an item in other letter case, whose names do not show, is found too; and
with every capitalised word that starts a sentence as a name.  A run of names is
one placeholder.  Signs and units joined to a number are words of their own, and
so is each letter of a script without spaces.

Slots are checked for each standing of an item by itself, so that other variants
in the same text hide nothing.

The templates of a benchmark of checked size go to the tasks.  Those of a larger
one stay a table, and the windows of both sides meet in a join by hash.

Defined results: NULL and empty texts hold nothing.  Items without a window of
``least_words`` words besides numbers, names and units match where they stand
whole, word by word;
items shorter than a window are looked up whole.  Long texts are searched whole.  Repeated documents are each
reported; benchmark rows that repeat an id are each compared and reported once
per id.  Rows without an item id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nbgauge.llm.common import fresh, quoted
from nbgauge.session import cut_lineage

RESULT = "array<struct<item_id long, coverage double, slots int, consistency double, kind string, first_word int, last_word int>>"
_FIELDS = pa.list_(pa.struct([
    ("item_id", pa.int64()), ("coverage", pa.float64()), ("slots", pa.int32()), ("consistency", pa.float64()), ("kind", pa.string()),
    ("first_word", pa.int32()), ("last_word", pa.int32()),
]))
_NUMBER = r"^[+-]?(?:\p{Nd}+(?:[.,:/]\p{Nd}+)*|\p{Nd}*\.\p{Nd}+)%?(?:st|nd|rd|th)?$"
# Units that make a placeholder after a number.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz ml cl l liter liters litre litres "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "% percent € $ £ usd eur dollar dollars euro euros cent cents k °c °f c f w kw v a hz khz mhz ghz mph kmh km/h m/s".split()
)
NUMBER, UNIT, NAME = 1, 2, 3
_EDGES = ".,;:!?\"'()[]{}«»“”‘’…|*，。？！、；：（）「」『』"

_CLOSING = "\"')]}»”’」』）"
_SIGNS = ("$", "€", "£", "¥")
# Letters of scripts written without spaces: each is a token.
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
# A number joined to a sign or a unit, but for ordinals.
_SIGNED = r"^([^\p{L}\p{Nd}$€£¥+-]*[$€£¥])([+-]?[.]?\p{Nd})"
_JOINED = r"^([^\p{L}\p{Nd}]*(?:\p{Nd}+(?:[.,:/]\p{Nd}+)*|[.]\p{Nd}+))([$€£¥°\p{L}][\p{L}/]*[^\p{L}\p{Nd}]*)$"
_ORDINAL = r"\p{Nd}(?:st|nd|rd|th)[^\p{L}\p{Nd}]*$"


def _pieces(words: pa.Array) -> pa.Array:
    """The tokens of each word: letters of unspaced scripts one by one, numbers apart from signs and units."""
    cut = pc.replace_substring_regex(words, _UNSPACED, r" \1 ")
    plain = pc.or_(pc.match_substring_regex(cut, _ORDINAL), pc.invert(pc.match_substring_regex(cut, r"\p{Nd}")))
    joined = pc.replace_substring_regex(pc.replace_substring_regex(cut, _SIGNED, r"\1 \2"), r"(^| )" + _JOINED[1:], r"\1\2 \3")
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.if_else(plain, cut, joined)))


def _known(words: pa.Array) -> tuple[np.ndarray, ...]:
    """Of each token by itself: its hash; whether it is a number, a unit, a sign, capitalised, and the end of a sentence."""
    bare = pc.utf8_trim(words, _EDGES)
    lower = pc.if_else(pc.equal(bare, ""), words, pc.utf8_lower(bare))
    rest = pc.utf8_slice_codeunits(bare, 1)
    told = (
        pc.match_substring_regex(bare, _NUMBER), pc.is_in(lower, pa.array(UNITS, lower.type)), pc.is_in(lower, pa.array(_SIGNS, lower.type)),
        pc.and_(pc.utf8_is_upper(pc.utf8_slice_codeunits(bare, 0, 1)), pc.equal(rest, pc.utf8_lower(rest))),
        pc.match_substring_regex(pc.utf8_rtrim(words, _CLOSING), "[.!?:。！？：]$"),
    )
    codes = np.fromiter(map(xxhash.xxh64_intdigest, lower.to_pylist()), dtype=np.uint64, count=len(words)) | np.uint64(4)
    return codes, *[flags.to_numpy(zero_copy_only=False) for flags in told]


#: Forms of a template: names typed; names as words; names and what starts a sentence with a capital typed; every token as it is.
TYPED, WORDS, WIDE, EXACT = range(4)


@dataclass
class Read:
    """The tokens of a text and its template in four forms."""

    pieces: pa.Array
    at: np.ndarray
    #: Word of each token.
    word: np.ndarray
    #: A hash per token, or NUMBER, UNIT, NAME, by form.
    codes: list[np.ndarray]
    #: Tokens at which elements of a form start: a run of names is one element.
    starts: list[np.ndarray]

    def __post_init__(self) -> None:
        self.forms = [codes[starts] for codes, starts in zip(self.codes, self.starts)]

    def tokens(self) -> list[str]:
        return self.pieces.take(pa.array(self.at)).to_pylist()

    def element(self, form: int, number: int) -> tuple[int, int]:
        """First token of an element and the one after its last."""
        starts = self.starts[form]
        return int(starts[number]), int(starts[number + 1]) if number + 1 < len(starts) else len(self.at)


class Canonicaliser:
    """Templates of texts, read about ``chunk`` bytes at a time."""

    def __init__(self, chunk: int = 1 << 22):
        self.chunk = chunk

    def read(self, texts: pa.Array) -> Iterator[Read]:
        texts = pc.utf8_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        sizes = pc.binary_length(texts).to_numpy()
        part = np.cumsum(sizes) // self.chunk
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for start, end in zip(cuts, cuts[1:]):
            yield from self._read(texts.slice(start, end - start), sizes[start:end])

    def _read(self, texts: pa.Array, sizes: np.ndarray) -> Iterator[Read]:
        split = pc.utf8_split_whitespace(texts)
        words, bounds = split.flatten(), split.offsets.to_numpy()
        # Each distinct word of the texts is looked at once.
        met = words.dictionary_encode()
        of = met.indices.to_numpy()
        cut = _pieces(met.dictionary)
        pieces, offsets = cut.flatten(), cut.offsets.to_numpy()
        count = np.diff(offsets)[of]
        ends_of = np.concatenate(([0], np.cumsum(count)))
        word = np.repeat(np.arange(len(of)), count)
        at = offsets[of][word] + np.arange(len(word)) - ends_of[word]
        begins, bounds = bounds[:-1], ends_of[bounds]
        exact, number, unit, sign, capital, ends = (known[at] for known in _known(pieces))
        first = np.zeros(len(at), dtype=bool)
        first[bounds[:-1]] = True
        code = exact.copy()
        code[unit & np.concatenate(([False], number[:-1])) & ~first] = UNIT
        code[sign & np.concatenate((number[1:] & ~first[1:], [False]))] = UNIT
        code[number] = NUMBER
        starts = np.concatenate(([True], ends[:-1])) | first
        capital &= code > NAME
        typed = np.where(capital & ~starts, np.uint64(NAME), code)
        wide = np.where(capital, np.uint64(NAME), code)
        new = [np.concatenate(([True], (t[1:] != NAME) | (t[:-1] != NAME))) | first for t in (typed, wide)]
        # A text without words splits into one empty word.
        for a, b, w in zip(bounds[:-1].tolist(), np.where(sizes > 0, bounds[1:], bounds[:-1]).tolist(), begins.tolist()):
            every = np.arange(b - a)
            yield Read(
                pieces, at[a:b], word[a:b] - w, [typed[a:b], code[a:b], wide[a:b], exact[a:b]],
                [np.flatnonzero(new[0][a:b]), every, np.flatnonzero(new[1][a:b]), every],
            )


def windows_of(template: np.ndarray, size: int) -> np.ndarray:
    n = len(template) - size + 1
    hashes = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(size if n > 0 else 0):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + template[i : i + n]
    return hashes ^ (hashes >> np.uint64(31))


@dataclass
class Templates:
    """Windows of a bounded number of benchmark items, ready to be looked up."""

    items: list[tuple[int, str]]
    window: int = 8
    least_words: int = 4
    coverage: float = 0.6
    consistency: float = 0.8

    def prepare(self) -> None:
        self.canon = Canonicaliser()
        self.read = list(self.canon.read(pa.array([text for _, text in self.items], pa.large_string())))
        self.tokens = [read.tokens() for read in self.read]
        #: Tokens at which the windows that carry evidence start, by item and form.
        self.kept: list[dict[int, set[int]]] = []
        rows: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for number, read in enumerate(self.read):
            kept: dict[int, set[int]] = {}
            for form, size, places, hashes in self.evidence(read):
                rows.setdefault((size, form), []).extend((h, number, p) for h, p in zip(hashes.tolist(), places.tolist()))
                kept[form] = set(read.starts[form][places].tolist())
            self.kept.append(kept)
        self.tables = {}
        for key, found in rows.items():
            found.sort()
            hashes, numbers, places = zip(*found)
            self.tables[key] = np.array(hashes, dtype=np.uint64), np.array(numbers), np.array(places)

    def evidence(self, read: Read) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """Form, size, places and hashes of an item's windows that carry evidence; an item without any has its beginning, as it is."""
        out = []
        for form in (TYPED, WORDS, WIDE):
            template = read.forms[form]
            size = min(self.window, len(template))
            places = self.telling(template, size)
            if len(places):
                out.append((form, size, places, windows_of(template, size)[places]))
        template = read.forms[EXACT]
        if not out and len(template):
            # Sizes are powers of two, so that few are looked up.
            size = 1 << (min(self.window, len(template)).bit_length() - 1)
            out.append((EXACT, size, np.zeros(1, dtype=np.int64), windows_of(template, size)[:1]))
        return out

    def telling(self, template: np.ndarray, size: int) -> np.ndarray:
        """Places of the windows with enough literal words: one of placeholders alone says nothing."""
        literal = template > NAME
        if literal.sum() < self.least_words:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(np.convolve(literal, np.ones(size, dtype=int), "valid") >= min(self.least_words, size))

    def find(self, text: str | None) -> list[dict]:
        return self.find_all(pa.array([text], pa.large_string()))[0]

    def find_all(self, texts: pa.Array) -> list[list[dict]]:
        return [self._find(read) for read in self.canon.read(texts)]

    def _find(self, read: Read) -> list[dict]:
        by_item: dict[int, list[tuple[int, int, int]]] = {}
        for (size, form), (hashes, items, places) in self.tables.items():
            own = windows_of(read.forms[form], size)
            if not len(own):
                continue
            low = np.searchsorted(hashes, own)
            at = np.flatnonzero((low < len(hashes)) & (hashes[np.minimum(low, len(hashes) - 1)] == own))
            high = np.searchsorted(hashes, own[at], side="right")
            for i, a, b in zip(at.tolist(), low[at].tolist(), high.tolist()):
                for j in range(a, b):
                    by_item.setdefault(int(items[j]), []).append((form, int(places[j]), i))
        out: dict[int, dict] = {}
        tokens: list[str] | None = None
        for item, hits in by_item.items():
            kept = self.kept[item]
            if EXACT in kept:
                result = self.whole(item, [i for _, _, i in hits], read)
            else:
                met = {int(self.read[item].starts[form][p]) for form, p, _ in hits}
                pooled = max(len(met & own) / len(own) for own in kept.values())
                if pooled < self.coverage:
                    continue
                tokens = read.tokens() if tokens is None else tokens
                result = self.best(item, hits, read, tokens, pooled)
            key = self.items[item][0]
            if result is not None and (key not in out or out[key]["coverage"] < result["coverage"]):
                out[key] = result
        return [out[k] for k in sorted(out)]

    def whole(self, item: int, places: list[int], read: Read) -> dict | None:
        """An item that stands in the text token by token."""
        mine, theirs = self.read[item].forms[EXACT], read.forms[EXACT]
        for i in places:
            if i + len(mine) <= len(theirs) and (theirs[i : i + len(mine)] == mine).all():
                slots = int((self.read[item].codes[TYPED] <= NAME).sum())
                return {
                    "item_id": self.items[item][0], "coverage": 1.0, "slots": slots, "consistency": 1.0, "kind": "verbatim",
                    "first_word": int(read.word[i]), "last_word": int(read.word[i + len(mine) - 1]),
                }
        return None

    def occurrences(self, hits: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
        """Hits that can be one standing of the item: those of one form and alignment, and such runs one after the other."""
        runs: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for hit in hits:
            runs.setdefault((hit[0], hit[2] - hit[1]), []).append(hit)
        yield from runs.values()
        for form in (TYPED, WORDS, WIDE):
            own = sorted((sorted(run) for (f, _), run in runs.items() if f == form), key=lambda run: run[0][2])
            last = max((run[-1][1] for run in own), default=0)
            for start in range(len(own)):
                chain = list(own[start])
                for run in own[start + 1 :]:
                    if chain[-1][1] >= last:
                        break
                    if run[0][1] > chain[-1][1] and run[0][2] > chain[-1][2]:
                        chain += run
                if len(chain) > len(own[start]):
                    yield chain

    def best(self, item: int, hits: list[tuple[int, int, int]], read: Read, tokens: list[str], pooled: float) -> dict | None:
        """The standing of the item that agrees best; if none by itself does, all hits of the text together."""
        found: dict | None = None
        for group in self.occurrences(hits):
            share = len({p for _, p, _ in group}) / len(self.kept[item][group[0][0]])
            if share < self.coverage:
                continue
            result = self.check(item, group, read, tokens, share)
            if result["consistency"] >= self.consistency and (found is None or self.rank(result) > self.rank(found)):
                found = result
        if found is None:
            result = self.check(item, hits, read, tokens, pooled)
            found = result if result["consistency"] >= self.consistency else None
        return found

    @staticmethod
    def rank(result: dict) -> tuple:
        return result["kind"] == "verbatim", result["coverage"], result["consistency"]

    def check(self, item: int, hits: list[tuple[int, int, int]], read: Read, tokens: list[str], share: float) -> dict:
        """Slots of the item against the words that stand in their places."""
        own, mine = self.read[item], self.tokens[item]
        meets = sorted({
            (own.element(form, p + k), read.element(form, i + k))
            for form, p, i in hits for k in range(min(self.window, len(own.forms[form])))
        })
        pairs = [
            (a, " ".join(t.strip(_EDGES).lower() for t in mine[a:b]), " ".join(t.strip(_EDGES).lower() for t in tokens[c:d]))
            for (a, b), (c, d) in meets
        ]
        slots = own.codes[TYPED] <= NAME
        wide = own.codes[WIDE] <= NAME
        # Words that start a sentence are slots where they differ.
        if any(one != two and wide[a] and not slots[a] for a, one, two in pairs):
            slots = wide
        there: dict[str, dict[str, int]] = {}
        for a, one, two in pairs:
            if slots[a]:
                counts = there.setdefault(one, {})
                counts[two] = counts.get(two, 0) + 1
        agree = sum(max(c.values()) for c in there.values())
        total = sum(sum(c.values()) for c in there.values())
        return {
            "item_id": self.items[item][0], "coverage": share, "slots": len(there), "consistency": agree / total if total else 1.0,
            "kind": "verbatim" if all(one == two for _, one, two in pairs) else "reparameterised",
            "first_word": int(read.word[min(c for _, (c, _) in meets)]), "last_word": int(read.word[max(d for _, (_, d) in meets) - 1]),
        }

    def matcher(self):
        """A column function over whole texts."""

        def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            self.prepare()
            for texts in batches:
                yield pa.array(self.find_all(texts), _FIELDS)

        match.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(match, RESULT)


def with_leaks(
    docs: DataFrame, benchmark: DataFrame, column: str = "leaks", shipped_items: int = 20_000, shipped_bytes: int = 1 << 25, **options
) -> DataFrame:
    """Add the benchmark items that each text holds.

    Map-only up to ``shipped_items`` items and ``shipped_bytes`` bytes of their
    texts, which are checked before anything is fetched; by a join beyond.  Both
    give the same.
    """
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    ).distinct()
    number, length = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if number > shipped_items or length > shipped_bytes:
        return _with_leaks_joined(docs, items, column, options)
    templates = Templates([(r["item_id"], r["text"]) for r in items.orderBy("item_id", "text").collect()], **options)
    return docs.withColumn(column, templates.matcher()(F.col("text").cast("string")))


_WINDOW_ROWS = pa.schema([("row", pa.int64()), ("size", pa.int32()), ("form", pa.int8()), ("place", pa.int32()), ("hash", pa.int64())])
_WINDOW_TYPES = "row long, size int, form tinyint, place int, hash long"


def _window_rows(templates: Templates, sizes: list[tuple[int, int]] | None, step: int = 200):
    """(row, text) to a row per window: those of an item that carry evidence, or all of a document, of the (size, form) given."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canonicaliser()
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                out: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)] for _ in range(5)]
                for row, read in zip(part.column(0).to_pylist(), canon.read(part.column(1))):
                    if sizes is None:
                        found = templates.evidence(read)
                    else:
                        hashed = ((form, size, windows_of(read.forms[form], size)) for size, form in sizes)
                        found = [(form, size, np.arange(len(hashes)), hashes) for form, size, hashes in hashed]
                    for form, size, places, hashes in found:
                        for values, value in zip(out, (row, size, form)):
                            values.append(np.full(len(places), value, dtype=np.int64))
                        out[3].append(read.starts[form][places])
                        out[4].append(hashes.view(np.int64))
                arrays = [pa.array(np.concatenate(v)).cast(f.type) for v, f in zip(out, _WINDOW_ROWS)]
                yield pa.RecordBatch.from_arrays(arrays, schema=_WINDOW_ROWS)

    return windows


def _with_leaks_joined(docs: DataFrame, items: DataFrame, column: str, options: dict) -> DataFrame:
    """As ``with_leaks``, the benchmark's windows as a table: hash join, then the pairs with enough of them are checked."""
    rules = Templates([], **options)
    (row,) = fresh(docs, "_row")
    docs = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    items = cut_lineage(items.withColumn("item", F.monotonically_increasing_id()))
    wanted = cut_lineage(items.select("item", "text").mapInArrow(_window_rows(rules, None), _WINDOW_TYPES)).withColumnsRenamed(
        {"row": "item", "place": "item_place"}
    )
    # At most ``window`` sizes of each form.
    sizes = [(r["size"], r["form"]) for r in wanted.select("size", "form").distinct().collect()]
    texts = docs.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text"))
    own = texts.mapInArrow(_window_rows(rules, sizes), _WINDOW_TYPES).drop("place").distinct()
    totals = wanted.groupBy("item", "form").agg(F.count(F.lit(1)).alias("n")).groupBy("item").agg(F.min("n").alias("least"))
    # Places met in any form, at least the share of the smaller form: no pair that ``find`` would keep is lost.
    met = own.join(wanted, ["size", "form", "hash"]).groupBy("row", "item").agg(F.count_distinct("item_place").alias("met"))
    pairs = met.join(totals, "item").where(F.col("met") >= F.col("least") * rules.coverage).select("row", "item")

    @F.arrow_udf(RESULT)
    def checked(texts: pa.Array, ids: pa.Array, wanted: pa.Array) -> pa.Array:
        out = []
        for text, item, words in zip(texts.to_pylist(), ids.to_pylist(), wanted.to_pylist()):
            one = Templates([(item, words)], **options)
            one.prepare()
            out.append(one.find(text))
        return pa.array(out, _FIELDS)

    told = pairs.join(texts, "row").join(items.withColumnRenamed("text", "item_text"), "item").select(
        "row", "item_text", F.explode(checked("text", "item_id", "item_text")).alias("leak")
    )
    best = told.groupBy("row", "leak.item_id").agg(F.min_by("leak", F.struct(-F.col("leak.coverage"), F.col("item_text"))).alias("leak"))
    found = best.groupBy("row").agg(F.sort_array(F.collect_list("leak")).alias(column)).withColumnRenamed("row", row)
    kept = docs.columns
    joined = docs.drop(column).join(found, row, "left")
    return joined.withColumn(column, F.coalesce(F.col(column), F.array().cast(RESULT))).select(
        *[quoted(c) for c in kept if c.lower() not in (row.lower(), column.lower())], column
    )


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document and benchmark item it holds."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark, "leaks", **options)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item."""
    (column,) = fresh(docs, "_leaks")
    return with_leaks(docs, benchmark, column, **options).where(F.size(column) == 0).drop(column)
