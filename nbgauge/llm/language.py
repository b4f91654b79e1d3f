"""Language of every text, word by word: script ranges, then Viterbi with a switching penalty.

Letters decide the script of a word; only languages written in it are
candidates.  Each word gets one score per candidate from letter n-grams, and the
best path over the words pays for every change of language, so that foreign
passages come out as spans and single odd words do not.

Defined results: a NULL text, one without letters, or nothing learned at all
gives ``und`` with score 0 and no span.  Words without letters are part of no
span.  Text without spaces is scored in pieces of PIECE characters, so its whole
length counts and one long word may lie in several spans.  Ties go to the language that sorts first.  Rows are scored one by one:
repeated rows give repeated results, other columns of the table play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nbgauge.llm.common import HELD_OUT_FOLD, fold, held_out, text_function

# First and last code point of the letters of a script (Unicode blocks).
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
}
RESULT = "lang string, score double, spans array<struct<start int, end int, lang string>>"
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])


_RANGES = sorted((a, b, name) for name, ranges in SCRIPTS.items() for a, b in ranges)
_STARTS = np.array([r[0] for r in _RANGES])
_ENDS = np.array([r[1] for r in _RANGES])
_NAMES = sorted(SCRIPTS)
_SCRIPT = np.array([_NAMES.index(r[2]) for r in _RANGES])
BUCKETS = 1 << 16
_END = ord("_")


def scripts_of(codes: np.ndarray) -> np.ndarray:
    """Number of the script of each code point, -1 for none of those listed."""
    at = np.maximum(np.searchsorted(_STARTS, codes, side="right") - 1, 0)
    return np.where((codes >= _STARTS[at]) & (codes <= _ENDS[at]), _SCRIPT[at], -1)


#: Longest piece of a word that is scored at a time.
PIECE = 64


def pieces_of(words: list[str]) -> tuple[list[str], np.ndarray]:
    """The words, long ones cut into pieces, and the number of each piece's word."""
    if max(map(len, words), default=0) <= PIECE:
        return words, np.arange(len(words))
    cut = [(word[i : i + PIECE], number) for number, word in enumerate(words) for i in range(0, len(word), PIECE)]
    return [piece for piece, _ in cut], np.array([number for _, number in cut], dtype=np.int64)


def letters_of(word: str) -> str:
    """The word's letters in lower case."""
    return (word if word.isalpha() else "".join(c for c in word if c.isalpha())).lower()


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and word of all letter pairs and triples, ends of words marked; script of each word's first letter."""
    codes = np.frombuffer(f"_{'_'.join(words)}_".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    word = np.cumsum(codes == _END) - 1
    mix = np.uint64(0x9E3779B97F4A7C15)
    pairs = codes[:-1] * mix + codes[1:]
    triples = (pairs[:-1] * mix + codes[2:]) * mix
    inner = codes[1:-1] != _END
    buckets = np.concatenate([(pairs * mix) >> np.uint64(48), triples[inner] >> np.uint64(48)]).astype(np.int64)
    # A pair that starts with a word's last letter ends at the mark after it.
    owner = np.concatenate([word[:-1], word[:-2][inner]])
    first = np.flatnonzero(codes[:-1] == _END) + 1
    return buckets, owner, scripts_of(codes[first].astype(np.int64))


@dataclass
class GramLogs:
    """Log probability of each bucket of letter groups in each language.

    Few languages are a full table; many are a list per bucket of the languages that
    have it, as most letter groups belong to few of them.
    """

    #: Log probability of a bucket that a language has not got.
    absent: np.ndarray
    #: Buckets x languages, or None.
    full: np.ndarray | None
    #: Where each bucket's list begins, the languages in it, and what they add to ``absent``.
    starts: np.ndarray
    languages: np.ndarray
    more: np.ndarray

    #: Languages of a full table.
    FULL = 128

    @classmethod
    def of(cls, counts: list[tuple[int, np.ndarray, np.ndarray]], n: int) -> GramLogs:
        """From (language, buckets, occurrences) of each language."""
        lang = np.concatenate([np.full(len(b), i) for i, b, _ in counts]) if counts else np.zeros(0, np.int64)
        bucket = np.concatenate([b for _, b, _ in counts]).astype(np.int64) if counts else lang
        seen = np.concatenate([c for _, _, c in counts]).astype(float) if counts else np.zeros(0)
        below = np.bincount(lang, weights=seen, minlength=n) + 0.3 * max(1, len(np.unique(bucket)))
        absent = np.log(0.3 / below)
        order = np.argsort(bucket, kind="stable")
        lang, bucket = lang[order], bucket[order]
        present = np.log((seen[order] + 0.3) / below[lang])
        starts = np.searchsorted(bucket, np.arange(BUCKETS + 1))
        if n > cls.FULL:
            return cls(absent, None, starts, lang.astype(np.int32), (present - absent[lang]).astype(np.float32))
        full = np.repeat(absent.astype(np.float32)[None], BUCKETS, axis=0)
        full[bucket, lang] = present
        return cls(absent, full, starts[:0], lang[:0], present[:0])

    def totals(self, buckets: np.ndarray, owner: np.ndarray, words: int) -> np.ndarray:
        """Sum over each word's buckets, words x languages."""
        n = len(self.absent)
        if self.full is not None:
            return np.stack([np.bincount(owner, weights=self.full[buckets, i], minlength=words) for i in range(n)], axis=1)
        total = np.bincount(owner, minlength=words)[:, None] * self.absent[None]
        sizes = self.starts[buckets + 1] - self.starts[buckets]
        at = np.repeat(self.starts[buckets] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        slot = np.repeat(owner, sizes) * n + self.languages[at]
        return total + np.bincount(slot, weights=self.more[at], minlength=words * n).reshape(words, n)


@dataclass
class LanguageModel:
    languages: list[str]
    #: languages x scripts: whether the language is written in it; the last column stands for other scripts.
    written: np.ndarray
    logs: GramLogs
    penalty: float = 8.0
    #: A word's score lies at most this far below its best language.
    floor: float = 6.0
    cached_scores: int = 20_000_000

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log score per word (of letters) and language, 0 for the best candidate."""
        buckets, owner, scripts = grams_of(words)
        total = self.logs.totals(buckets, owner, len(words))
        candidates = self.written[:, scripts].T
        candidates = candidates | ~candidates.any(axis=1, keepdims=True)
        total = 0.6 * total
        total -= np.where(candidates, total, -np.inf).max(axis=1, keepdims=True)
        return np.where(candidates, np.maximum(total, -self.floor), -4 * self.floor).astype(np.float32)

    def scorer(self):
        """Function of a list of texts giving one RESULT per text."""
        model = self

        class Words(dict):
            """Row of each word in the score table; new words wait for their scores."""

            def __missing__(self, word: str) -> int:
                letters = letters_of(word)
                if letters:
                    waiting.append(letters)
                    self[word] = counted[0] = counted[0] + 1
                else:
                    self[word] = -1
                return self[word]

        index, waiting, counted = Words(), [], [-1]
        tables: list[np.ndarray] = []

        def score(texts: list) -> pa.Array:
            out: list = [("und", 0.0, [])] * len(texts)
            if not model.languages:
                return _results(out)
            start = 0
            while start < len(texts):
                if len(index) * len(model.languages) > model.cached_scores:
                    index.clear()
                    tables.clear()
                    counted[0] = -1
                numbers, ids, owners, words, at = [], [], [], 0, start
                # As many texts at a time as give some millions of scores.
                while at < len(texts) and words * len(model.languages) < 4_000_000:
                    split, owner = pieces_of((texts[at] or "").split())
                    found = np.fromiter(map(index.__getitem__, split), dtype=np.int64, count=len(split))
                    if (found >= 0).any():
                        numbers.append(at)
                        ids.append(found)
                        owners.append(owner)
                        words += len(found)
                    at += 1
                if waiting:
                    tables.append(model.word_scores(waiting))
                    waiting.clear()
                    tables[:] = [np.concatenate(tables)]
                if numbers:
                    for number, result in zip(numbers, model.label(ids, owners, tables[0])):
                        out[number] = result
                start = at
            return _results(out)

        return score

    def label(self, ids: list[np.ndarray], owners: list[np.ndarray], scores: np.ndarray) -> list[tuple[str, float, list]]:
        known = [np.flatnonzero(i >= 0) for i in ids]
        own = [scores[i[p]] for i, p in zip(ids, known)]
        places = [owner[p] for owner, p in zip(owners, known)]
        paths: list = [self._single(s) for s in own]
        mixed = sorted((k for k, p in enumerate(paths) if p is None), key=lambda k: -len(own[k]))
        if mixed:
            for k, path in zip(mixed, best_paths([own[k] for k in mixed], self.penalty)):
                paths[k] = path
        results = []
        for place, path in zip(places, paths):
            if isinstance(path, int):
                results.append((self.languages[path], 1.0, [(int(place[0]), int(place[-1]) + 1, self.languages[path])]))
                continue
            count = np.bincount(path, minlength=len(self.languages))
            best = int(count.argmax())
            cuts = np.flatnonzero(np.diff(path)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(path)]))
            spans = [
                (int(place[a]), int(place[b - 1]) + 1, self.languages[path[a]]) for a, b in zip(starts.tolist(), ends.tolist())
            ]
            results.append((self.languages[best], float(count[best] / len(path)), spans))
        return results

    def _single(self, scores: np.ndarray) -> int | None:
        """The language of a text whose best path never changes, if that is plain.

        No run of words gains more than one switch costs by leaving the language.
        """
        best = int(scores.sum(axis=0).argmax())
        gains = np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64)
        gains = np.concatenate([np.zeros((1, gains.shape[1])), gains])
        return best if (gains - np.minimum.accumulate(gains, axis=0)).max() < self.penalty else None


def best_paths(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Viterbi over texts in step; the longest text must come first.

    A path either stays or changes from the best language so far, so a step
    costs as much as the number of languages, not its square.
    """
    lengths = np.array([len(s) for s in scores])
    offsets = np.cumsum(lengths) - lengths
    flat = np.concatenate(scores).astype(np.float64)
    stays = np.zeros(flat.shape, dtype=bool)
    leaders = np.zeros(len(flat), dtype=np.int32)
    finals = flat[offsets]
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(int(lengths[0]))]
    for t, k in enumerate(active[1:], 1):
        at = offsets[:k] + t
        value = finals[:k]
        leader = value.argmax(axis=1)
        change = value[np.arange(k), leader][:, None] - penalty
        stay = value >= change
        stays[at], leaders[at] = stay, leader
        finals[:k] = np.where(stay, value, change) + flat[at]
    path = np.zeros(len(flat), dtype=np.int32)
    state = finals.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = offsets[:k] + t
        path[at] = state[:k]
        if t:
            state[:k] = np.where(stays[at, state[:k]], state[:k], leaders[at])
    return [path[o : o + n] for o, n in zip(offsets, lengths)]


def _results(out: list[tuple]) -> pa.Array:
    spans = pa.array([[{"start": a, "end": b, "lang": c} for a, b, c in r[2]] for r in out], type=pa.list_(SPAN))
    return pa.StructArray.from_arrays(
        [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.float64()), spans],
        names=["lang", "score", "spans"],
    )


def fit_languages(docs: DataFrame, per_language: int = 1500, penalty: float = 8.0) -> LanguageModel:
    """Learn letter groups from about ``per_language`` texts of each language.

    Only rows outside the held-out fold with a text and a language are read.
    ``per_language`` (expected number, chosen by a hash of the id) bounds what is
    learned of a language; all languages are learned.  Spark counts, and one list
    of at most BUCKETS counts per language comes to the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != HELD_OUT_FOLD))
    sizes = known.groupBy("lang").count().collect()
    if not sizes:
        return LanguageModel([], np.zeros((0, len(_NAMES) + 1), bool), GramLogs.of([], 0), penalty)
    languages = sorted(r["lang"] for r in sizes)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["count"]))])
    hash_share = F.pmod(F.xxhash64("doc_id", F.lit("languages")), F.lit(1_000_000)) / 1_000_000
    sample = known.where(hash_share < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(lang, Counter()).update(pieces_of(text.split())[0])
            for lang, counts in texts.items():
                pairs = [(letters, n) for w, n in counts.items() if (letters := letters_of(w))]
                if not pairs:
                    continue
                n = np.array([p[1] for p in pairs])
                buckets, owner, scripts = grams_of([p[0] for p in pairs])
                counted = np.bincount(buckets, weights=n[owner], minlength=BUCKETS)
                # Scripts follow the buckets.
                by_script = np.bincount(scripts + (scripts < 0) * (len(_NAMES) + 1), weights=n, minlength=len(_NAMES) + 1)
                every = np.concatenate([counted, by_script]).astype(np.int64)
                at = np.flatnonzero(every)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(every[at])], names=["lang", "bucket", "n"]
                )

    counted = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counted.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts")).toArrow()
    number = {lang: i for i, lang in enumerate(languages)}
    counts, scripts = [], np.zeros((len(_NAMES) + 1, len(languages)))
    for lang, buckets, n in zip(rows["lang"].to_pylist(), rows["buckets"], rows["counts"]):
        at, n = np.asarray(buckets.values), np.asarray(n.values)
        scripts[at[at >= BUCKETS] - BUCKETS, number[lang]] = n[at >= BUCKETS]
        counts.append((number[lang], at[at < BUCKETS], n[at < BUCKETS]))
    written = scripts.T >= 0.01 * np.maximum(scripts.sum(axis=0), 1)[:, None]
    return LanguageModel(languages, written, GramLogs.of(counts, len(languages)), penalty)


def with_language(docs: DataFrame, model: LanguageModel, column: str = "language") -> DataFrame:
    """Add a struct of the language, its share of the words and the spans. Map-only."""
    return docs.withColumn(column, text_function(model.scorer(), RESULT)(F.col("text")))


def predict_languages(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans of every document."""
    rows = docs.select("doc_id", "text", "lang")
    model = model or fit_languages(rows)
    scored = with_language(rows.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", "language.spans"
    )
