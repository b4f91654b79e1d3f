"""Removal of passages that repeat across documents, by suffix automata.

A window is a run of ``window`` words.  Words covered by a window that also
starts earlier (in a smaller document, or further up in the same) are removed.

1. Anchors.  Of the short word runs in a window the one with the least hash is
   its anchor; equal windows have equal anchors, and consecutive windows mostly
   share one.  Anchors met only once rule their windows out.
2. Reference shards.  The words around the other anchors (contexts: the
   windows that share the anchor) are dealt to shards by anchor.  An anchor found
   in very many blocks of documents has its windows dealt out one by one, by the
   hash of the window, so that no passage makes a large shard.
3. Suffix automata.  A shard's contexts, in the order in which they occur, are
   streamed through the automaton of those before; where the matching statistic
   reaches ``window``, the window ending there was seen.  Then the context is added.
   Equal contexts are streamed once and share the result.
4. The windows found go back to their documents; maximal runs of covered words go.

Documents stay in blocks of about ``block_rows``, dealt by a hash, shuffled once
and used three times; what moves between the steps are packed anchors, contexts
and positions.

Defined results: words are runs of anything but space, tab and line ends; NULL
and empty texts have none.  Rows with one id but different texts are ordered by
a hash of the text; rows equal in both are one document that is listed several
times.  Long texts are cut into words whole; a word may be of any length.  A NULL id comes before all others.  Texts of fewer words than a window
lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nbgauge.llm.common import fresh

WINDOW, ANCHOR = 20, 6
#: Blocks that may hold an anchor before its windows are dealt out one by one.
HOT_BLOCKS = 32
#: Words of an automaton before the next anchor starts another.
SHARD_WORDS = 200_000
CONTEXT_WINDOWS = 63
_FIRST_ID = np.iinfo(np.int64).min
_PLACED = "block long, doc int, start int, seen long"


class _Hashes(dict):
    """64-bit hash of each word; forgets when too many are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def anchors_of(words: list[bytes], window: int = WINDOW, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each anchor, and the first and last window start that share it."""
    n = len(words) - window + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    each = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    runs = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for i in range(size):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + each[i : i + len(runs)]
    runs ^= runs >> np.uint64(29)
    runs *= np.uint64(0xBF58476D1CE4E5B9)
    runs ^= runs >> np.uint64(32)
    view = np.lib.stride_tricks.sliding_window_view(runs, window - size + 1)
    at = np.arange(n) + view.argmin(axis=1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return runs[at[first]], first, np.append(first[1:], n) - 1


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, state: int, move, target: int) -> int:
        copy = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(move) == target:
            self.next[state][move] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, move) -> int:
        nexts, link, length = self.next, self.link, self.length
        if move in nexts[last]:
            target = nexts[last][move]
            return target if length[target] == length[last] + 1 else self._clone(last, move, target)
        new = self._state(length[last] + 1, {}, 0)
        state = last
        while state >= 0 and move not in nexts[state]:
            nexts[state][move] = new
            state = link[state]
        if state >= 0:
            target = nexts[state][move]
            link[new] = target if length[target] == length[state] + 1 else self._clone(state, move, target)
        return new

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def matches(self, words: list) -> list[int]:
        """Matching statistics: the longest run ending at each word that occurs in the sequences added."""
        nexts, link, lengths = self.next, self.link, self.length
        state = length = 0
        out = []
        for word in words:
            while state and word not in nexts[state]:
                state = link[state]
                length = lengths[state]
            if word in nexts[state]:
                state = nexts[state][word]
                length += 1
            else:
                length = 0
            out.append(length)
        return out


# -- what a block of documents gives and takes ---------------------------------


class _Block:
    """Rows of a block in the order (id, hash of the text)."""

    def __init__(self, table: pa.Table):
        ids = table["_id"].to_numpy()
        hashes = table["_hash"].to_numpy()
        self.order = np.lexsort((hashes, ids))
        self.ids, self.hashes = ids[self.order], hashes[self.order]
        texts = table["text"].take(pa.array(self.order)).cast(pa.large_binary())
        self.words = [(t.as_py() or b"").split() for t in texts]


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 3)


def _unpack(data: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n = len(raw) // sum(np.dtype(t).itemsize for t in types)
    out, at = [], 0
    for t in types:
        size = n * np.dtype(t).itemsize
        out.append(np.frombuffer(raw[at : at + size], dtype=t))
        at += size
    return out


def _block_anchors(window: int, size: int, shards: int):
    """Distinct anchors of a block by shard, and whether the block holds them twice."""

    def find(key: tuple, table: pa.Table) -> pa.Table:
        block = _Block(table)
        found = [anchors_of(words, window, size)[0] for words in block.words]
        values, counts = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
        shard = (values % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        values, counts, shard = values[order], counts[order], shard[order]
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        ends = np.append(cuts[1:], len(shard))
        rows = [(int(shard[a]), key[0].as_py(), _pack(values[a:b], counts[a:b] > 1)) for a, b in zip(cuts, ends)]
        return _table(rows, ["shard", "block", "anchors"], [pa.int64(), pa.int64(), pa.binary()])

    return find


def _repeated_anchors(key: tuple, table: pa.Table) -> pa.Table:
    """For each block its anchors that occur more than once anywhere, and which of them are in very many blocks."""
    blocks = table["block"].to_pylist()
    parts = [_unpack(a, np.uint64, np.bool_) for a in table["anchors"].to_pylist()]
    values, inverse, counts = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True, return_counts=True)
    twice = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]), minlength=len(values)) > 0
    repeated, hot = (counts > 1) | twice, counts > HOT_BLOCKS
    rows, at = [], 0
    for block, (own, _) in zip(blocks, parts):
        which = inverse[at : at + len(own)]
        at += len(own)
        keep = repeated[which]
        if keep.any():
            rows.append((block, _pack(own[keep], hot[which][keep])))
    return _table(rows, ["block", "anchors"], [pa.int64(), pa.binary()])


def _block_contexts(window: int, size: int, shards: int):
    """Contexts of a block's repeated anchors by shard: distinct texts, and where each occurs."""

    def find(key: tuple, documents: pa.Table, anchors: pa.Table) -> pa.Table:
        if not documents.num_rows or not anchors.num_rows:
            return _table([], ["shard", "block", "texts", "heads", "places"], _CONTEXT_TYPES)
        block = _Block(documents)
        parts = [_unpack(a, np.uint64, np.bool_) for a in anchors["anchors"].to_pylist()]
        known = np.concatenate([p[0] for p in parts])
        order = np.argsort(known)
        known, hot = known[order], np.concatenate([p[1] for p in parts])[order]
        texts: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        for number, words in enumerate(block.words):
            hashes, first, last = anchors_of(words, window, size)
            if not len(hashes):
                continue
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            for i in np.flatnonzero(known[at] == hashes).tolist():
                a, b = int(first[i]), int(last[i])
                if hot[at[i]]:
                    for start in range(a, b + 1):
                        text = b" ".join(words[start : start + window])
                        texts.setdefault((xxhash.xxh64_intdigest(text), text), []).append((number, start))
                else:
                    # What is found is kept in the bits of a long, so a context has at most that many windows.
                    for start in range(a, b + 1, CONTEXT_WINDOWS):
                        text = b" ".join(words[start : min(b, start + CONTEXT_WINDOWS - 1) + window])
                        texts.setdefault((int(hashes[i]), text), []).append((number, start))
        by_shard: dict[int, list] = {}
        for (anchor, text), places in texts.items():
            by_shard.setdefault(anchor % shards, []).append((anchor, text, places))
        rows = []
        for shard, items in by_shard.items():
            docs = np.array([p[0] for _, _, places in items for p in places], dtype=np.int32)
            starts = np.array([p[1] for _, _, places in items for p in places], dtype=np.int32)
            rows.append((
                shard, key[0].as_py(), zstandard.compress(b"\n".join(t for _, t, _ in items), 3),
                _pack(np.array([a for a, _, _ in items], dtype=np.uint64), np.array([len(p) for _, _, p in items], dtype=np.int64)),
                _pack(block.ids[docs], block.hashes[docs], docs, starts),
            ))
        return _table(rows, ["shard", "block", "texts", "heads", "places"], _CONTEXT_TYPES)

    return find


_CONTEXT_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _match_shard(window: int):
    """Windows of a shard's contexts that occur earlier, for each place."""

    def match(key: tuple, table: pa.Table) -> pa.Table:
        texts: list[bytes] = []
        anchors, context, blocks, places = [], [], [], []
        for block, packed, heads, where in zip(*[table[c].to_pylist() for c in ("block", "texts", "heads", "places")]):
            here = zstandard.decompress(packed).split(b"\n")
            anchor, counts = _unpack(heads, np.uint64, np.int64)
            place = _unpack(where, np.int64, np.int64, np.int32, np.int32)
            context.append(np.repeat(np.arange(len(here)) + len(texts), counts))
            blocks.append(np.full(len(place[0]), block))
            places.append(place)
            anchors.append(anchor)
            texts += here
        anchors = np.concatenate(anchors)
        # Equal texts of several blocks become one context.
        numbers: dict[tuple[int, bytes], int] = {}
        same = np.array([numbers.setdefault(pair, len(numbers)) for pair in zip(anchors.tolist(), texts)])
        context, blocks = same[np.concatenate(context)], np.concatenate(blocks)
        ids, hashes, docs, starts = [np.concatenate([p[i] for p in places]) for i in range(4)]
        order = np.lexsort((starts, hashes, ids, context))
        context, blocks, ids, hashes, docs, starts = [x[order] for x in (context, blocks, ids, hashes, docs, starts)]
        head = np.flatnonzero(np.diff(context, prepend=-1))
        first = head[context]  # each context's first place
        distinct = list(numbers)
        by_anchor = sorted(range(len(distinct)), key=lambda c: (distinct[c][0], ids[head[c]], hashes[head[c]], starts[head[c]]))
        seen = np.zeros(len(distinct), dtype=np.int64)
        whole = np.zeros(len(distinct), dtype=np.int64)
        automaton, added, before = Automaton(), 0, None
        for at, c in enumerate(by_anchor):
            anchor, text = distinct[c]
            if anchor != before and added > SHARD_WORDS:
                automaton, added = Automaton(), 0
            words = text.split(b" ")
            whole[c] = (1 << (len(words) - window + 1)) - 1
            if anchor == before:
                for end, length in enumerate(automaton.matches(words)[window - 1 :]):
                    if length >= window:
                        seen[c] |= 1 << end
            follows = at + 1 < len(by_anchor) and distinct[by_anchor[at + 1]][0] == anchor
            if follows and seen[c] != whole[c]:
                automaton.add(words)
                added += len(words)
            before = anchor
        # The first document to hold a context there keeps what its own stream left; all later places were seen.
        is_first = (ids == ids[first]) & (hashes == hashes[first]) & (starts == starts[first])
        result = np.where(is_first, seen[context], whole[context])
        keep = result != 0
        return pa.table({
            "block": pa.array(blocks[keep], pa.int64()), "doc": pa.array(docs[keep], pa.int32()),
            "start": pa.array(starts[keep], pa.int32()), "seen": pa.array(result[keep], pa.int64()),
        })

    return match


def covered(n_words: int, starts: np.ndarray, seen: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window found at ``starts`` plus the set bits of ``seen``."""
    change = np.zeros(n_words + 1, dtype=np.int64)
    for bit in range(63):
        at = starts[(seen >> bit) & 1 == 1] + bit
        if len(at):
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
        elif not (seen >> bit).any():
            break
    return np.cumsum(change[:-1]) > 0


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _kept_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; other white space stays as it is."""
    raw = text.encode()
    blank = np.isin(np.frombuffer(raw, dtype=np.uint8), (9, 10, 11, 12, 13, 32))
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else len(raw)
    parts.append(raw[at:])
    return b"".join(parts).decode()


def _rewrite(columns: list[str], window: int, keep_text: bool):
    """The rows of a block with what was removed; texts only if they are wanted."""

    def rewrite(key: tuple, documents: pa.Table, found: pa.Table) -> pa.Table:
        block = _Block(documents)
        doc, start, seen = [found[c].to_numpy() for c in ("doc", "start", "seen")]
        order = np.argsort(doc, kind="stable")
        doc, start, seen = doc[order], start[order].astype(np.int64), seen[order]
        lo, hi = np.searchsorted(doc, np.arange(len(block.words))), np.searchsorted(doc, np.arange(len(block.words)), side="right")
        n_words, n_removed, digests, spans = [], [], [], []
        for i, words in enumerate(block.words):
            flags = covered(len(words), start[lo[i] : hi[i]], seen[lo[i] : hi[i]], window)
            kept = [w for w, gone in zip(words, flags.tolist()) if not gone] if flags.any() else words
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            spans.append([{"first": a, "last": b} for a, b in _spans(flags)])
        rows = documents.take(pa.array(block.order))
        out = {f"c{i}": rows[f"c{i}"] if c != "text" else rows["text"] for i, c in enumerate(columns) if keep_text or c != "text"}
        names = [*out, "n_words", "n_removed", "kept_sha256", "spans"]
        arrays = [*out.values(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()),
                  pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))]
        if keep_text:
            names.append("kept")
            kept_texts = [t if not s else _kept_text(t, [(x["first"], x["last"]) for x in s]) for t, s in zip(rows["text"].to_pylist(), spans)]
            arrays.append(pa.array(kept_texts, pa.string()))
        return pa.Table.from_arrays(arrays, names=names)

    return rewrite


def _table(rows: list[tuple], names: list[str], types: list) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def remove_repeats(docs: DataFrame, window: int = WINDOW, block_rows: int = 500, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` with new ones after them.

    n_words, n_removed, kept_sha256 (of the kept words joined by one space),
    removed_spans (first word, word after the last) and kept_text.  Names that
    ``docs`` has already get an underscore.  Without ``keep_text`` neither kept_text
    nor the text itself comes back.
    """
    if window < 1:
        raise ValueError("a window has at least one word")
    size = min(ANCHOR, window)
    rows = docs.select("doc_id").count()
    blocks = max(1, -(-rows // block_rows))
    shards = max(1, -(-blocks // 8))
    columns = docs.columns
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns) if c != "text"]
    text = F.col("text").cast("string")
    hashed = F.xxhash64(text)
    placed = docs.select(
        *others, text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST_ID)).alias("_id"), hashed.alias("_hash"),
        F.pmod(F.xxhash64("doc_id", hashed), F.lit(blocks)).alias("block"),
    )
    grouped = placed.groupBy("block")
    anchors = grouped.applyInArrow(_block_anchors(window, size, shards), "shard long, block long, anchors binary")
    repeated = anchors.groupBy("shard").applyInArrow(_repeated_anchors, "block long, anchors binary")
    contexts = grouped.cogroup(repeated.groupBy("block")).applyInArrow(
        _block_contexts(window, size, shards), "shard long, block long, texts binary, heads binary, places binary"
    )
    found = contexts.groupBy("shard").applyInArrow(_match_shard(window), _PLACED)
    back = [(i, c) for i, c in enumerate(columns) if keep_text or c != "text"]
    kinds = [f"c{i} {docs.schema[c].dataType.simpleString() if c != 'text' else 'string'}" for i, c in back]
    new = "n_words long, n_removed long, kept_sha256 string, spans array<struct<first int, last int>>" + ", kept string" * keep_text
    out = grouped.cogroup(found.groupBy("block")).applyInArrow(_rewrite(columns, window, keep_text), ", ".join([*kinds, new]))
    names = fresh(docs, "n_words", "n_removed", "kept_sha256", "removed_spans", "kept_text")
    return out.toDF(*[c for _, c in back], *names[: 4 + keep_text])
