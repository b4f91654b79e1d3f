"""The operators' contracts written out plainly, for tables that fit in memory."""

from __future__ import annotations

import hashlib
import re

import xxhash


def words(text):
    return (text or "").encode().split()


def repeats(rows, window=20):
    """(doc_id, n_words, n_removed, kept_sha256) of rows (doc_id, text) with distinct ids."""
    first = {}
    split = {doc: words(text) for doc, text in rows}
    for doc in sorted(split):
        w = split[doc]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (doc, i))
    out = []
    for doc, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (doc, i):
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def simhash(text):
    w = words((text or ""))
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def near_groups(marks, budget=3):
    """Component (smallest id) of each (id, fingerprint)."""
    parent = {i: i for i, _ in marks}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, f) in enumerate(marks):
        for b, g in marks[:n]:
            if (f ^ g).bit_count() <= budget:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in marks}


def hilbert_index(point, bits):
    """Index of a point on the Hilbert curve: turn the cells from the top bit down, then read them as a Gray code."""
    x = list(point)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i, value in enumerate(x):
            value = x[i]
            if value & bit:
                x[0] ^= low
            else:
                swap = (x[0] ^ value) & low
                x[0] ^= swap
                x[i] ^= swap
    index, before = 0, 0
    for level in range(bits - 1, -1, -1):
        for value in x:
            before ^= value >> level & 1
            index = index << 1 | before
    return index


def template_matches(items, names, text):
    """(item, kind) of the items that stand in a text whole, as told or with other numbers and names in their slots."""
    found = []
    for n, item in enumerate(items):
        words = item.split()
        slots = [w for w in words if w.isdigit() or w in names]
        pattern = r"(?<!\S)" + " ".join(r"(\d+)" if w.isdigit() else r"([A-Z][a-z]+)" if w in names else re.escape(w) for w in words) + r"(?!\S)"
        matches = [m.groups() for m in re.finditer(pattern, text)]
        consistent = [m for m in matches if len(set(zip(slots, m))) == len(set(slots))]
        if tuple(slots) in matches:
            found.append((n, "verbatim"))
        elif consistent:
            found.append((n, "reparameterised"))
    return found
