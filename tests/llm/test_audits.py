"""Vector codes, source divergence and embedding near-duplicates against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from nbgauge.llm import codes, divergence, subspaces

VECTORS = "vec_id long, embedding array<float>, label int, code string, node long, error long, upper string"


def vectors(spark, rows, kind="float"):
    """Rows (vec_id, vector, label) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], VECTORS.replace("float", kind))


def cloud(seed, n, length=16, centres=6, noise=0.3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, length))
    return [[float(np.float32(x)) for x in middle[rng.integers(centres)] + noise * rng.normal(size=length)] for _ in range(n)]


NAN, INF = float("nan"), float("inf")
BAD = [(901, None, 1), (902, [], 1), (903, [0.1, None] * 8, 2), (904, [NAN] + [0.0] * 15, None), (905, [INF] + [0.0] * 15, 2)]


# -- codes ----------------------------------------------------------------------


def plain_codes(rows, entries=256, rounds=4):
    kept = sorted((r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[int(np.floor(1024 * v)) for v in r[1]] for r in kept])
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % 4))).reshape(len(kept), 4, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        far = ((x[:, :, None] - books[None]) ** 2).sum(axis=3)
        code = far.argmin(axis=2)
        for p in range(4 if turn < rounds else 0):
            for e in set(code[:, p].tolist()):
                own = x[code[:, p] == e, p]
                books[p, e] = [int(total) // len(own) for total in own.sum(axis=0)]
    error = far.min(axis=2).sum(axis=1)
    labels = Counter()
    for r, e in zip(kept, error.tolist()):
        labels[r[2]] += e
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()
    return sorted(
        ((r[0], "".join(f"{c:02x}" for c in row), e, labels[r[2]], digest) for r, row, e in zip(kept, code.tolist(), error.tolist())), key=repr
    )


@pytest.mark.parametrize("entries,bounds,length", [(256, 24, 16), (40, 5, 16), (7, 1, 14), (300 - 44, 60, 4), (1, 24, 8)])
def test_codes_as_plain(spark, entries, bounds, length):
    points = cloud(entries, 700, length)
    rows = [(i // 2 if i % 9 == 0 else i, p, i % 4 or None) for i, p in enumerate(points)]
    rows += [(2000 + i, points[i % 3], 1) for i in range(40)] + [(None, points[5], None), (3, points[3], 3), (3, points[3], 3)]
    found = codes.vector_codes(vectors(spark, rows + BAD).repartition(5), entries=entries, bounds=bounds).collect()
    assert sorted(map(tuple, found), key=repr) == plain_codes(rows, entries)


def test_codes_bounds_shrink_and_spare_distances(spark):
    """Far-apart groups: after the first round hardly a part looks at more than its own entry."""
    rows = [(i, p, 1) for i, p in enumerate(cloud(3, 800, 16, centres=8, noise=0.01))]
    state, _ = codes.train(vectors(spark, rows), entries=8, bounds=6)
    looked = [x for r in state.select("looked", "near").collect() for x in r["looked"]]
    assert sum(x == 0 for x in looked) > 0.8 * len(looked)
    assert len(state.first()["near"]) < 4 * 6


def test_codes_of_few_odd_vectors(spark):
    assert codes.vector_codes(vectors(spark, BAD)).count() == 0
    empty = vectors(spark, []).limit(0)
    assert codes.vector_codes(empty).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and codes.vector_codes(empty).count() == 0
    # Ties go to the lower index, also between equal entries; floors go down.
    rows = [(1, [0.0, -0.0005, 0.0, 0.0], None), (2, [0.0, -0.0005, 0.0, 0.0], None), (3, [0.002, 0.0, 0.0, 0.0], 1)]
    found = codes.vector_codes(vectors(spark, rows + [(0, [1.0] * 5, 2)]).where("vec_id > 0")).collect()
    assert sorted(map(tuple, found)) == plain_codes(rows)
    # Another length than the smallest id's takes no part.
    assert [r.vec_id for r in codes.vector_codes(vectors(spark, rows + [(9, [1.0] * 5, 2)])).orderBy("vec_id").collect()] == [1, 2, 3]
    with pytest.raises(Exception, match="beyond the exact distances"):
        codes.vector_codes(vectors(spark, [(1, [5000.0] * 4, 1)])).collect()


# -- divergence -----------------------------------------------------------------


def plain_divergence(rows, least_docs=30, top=50):
    groups, docs, langs = {}, {}, {}
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        own = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))
        groups.setdefault((lang, source), Counter()).update(own)
        docs.setdefault(lang, Counter()).update(own.keys())
        langs.setdefault(lang, Counter()).update(own)
    kept = {lang: [t for t, n in counts.items() if n >= least_docs] for lang, counts in docs.items()}

    def shares(counts, lang):
        total = sum(counts[t] for t in kept[lang]) + 5 * len(kept[lang])
        return {t: 1 + 10**9 * (counts[t] + 5) // total for t in kept[lang]}

    p = {g: shares(c, g[0]) for g, c in groups.items()}
    q = {lang: shares(c, lang) for lang, c in langs.items()}
    out = []
    for (lang, source), own in p.items():
        pairs = [(s, sum(abs(own[t] - p[lang, s][t]) for t in kept[lang])) for l, s in p if l == lang and s != source]
        terms = [(t, own[t] - q[lang][t]) for t in kept[lang] if groups[lang, source][t] and own[t] > q[lang][t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


def texts(spark, rows):
    schema = "doc_id long, text string, lang string, source string, term string, p long, n long, block int, item string"
    return spark.createDataFrame([(i, *r, "x", 1, 2, 3, "y") for i, r in enumerate(rows)], schema)


def corpus(seed, n, sources, langs=("en", "de", None)):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Alpha", "beta", "straße", "ЖУК", "x", "日本", "é") for b in "abcdefghij"]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(langs), f"s{min(rng.randrange(sources), rng.randrange(sources))}"
        lean = zlib.crc32(f"{lang} {source}".encode()) % len(words)
        text = rng.choice([" ", "-", "7", "\x00", "_"]).join(words[(lean + int(rng.expovariate(0.1))) % len(words)] for _ in range(rng.randrange(20)))
        rows.append((text, lang, source if rng.random() > 0.02 else None))
    return rows


def test_counts_do_not_depend_on_what_is_held(spark):
    docs = texts(spark, corpus(4, 300, 5))
    few, many = (sorted(map(tuple, divergence.term_counts(docs, held).collect()), key=repr) for held in (3, 200_000))
    assert few == many


@pytest.mark.parametrize("group_block,term_block", [(64, 512), (2, 5), (1, 1000)])
def test_divergence_as_plain(spark, group_block, term_block):
    rows = corpus(group_block, 500, 9) + [(None, "en", "no words"), ("", "xx", "alone"), ("Rare word", "yy", "a"), ("12 34", "yy", "b"), ("A" * 9, None, None)]
    docs = texts(spark, rows).repartition(3)
    found = divergence.audit(docs, least_docs=12, group_block=group_block, term_block=term_block, top=7)
    assert sorted(map(tuple, found.collect())) == plain_divergence(rows, 12, 7)


def test_divergence_of_odd_tables(spark):
    assert divergence.audit(texts(spark, []).limit(0)).count() == 0
    long = "word " * 300_000 + "Other" * 50_000
    rows = [(long, "en", "a")] + [("word Other", "en", "b")] * 29
    assert sorted(map(tuple, divergence.audit(texts(spark, rows)).collect())) == plain_divergence(rows)
    # No term is kept: pairs of value 0.
    assert sorted(map(tuple, divergence.audit(texts(spark, rows[1:] + [("", "en", "c")])).collect())) == [
        ("en", "b", "pair", "c", 0, 1), ("en", "c", "pair", "b", 0, 1)
    ]


def test_share_beyond_64_bits(spark):
    row = spark.sql("SELECT 9000000000000000000L AS n, 9100000000000000000L AS total, 10L AS v").select(divergence.share("n", "total", "v")).first()
    assert row[0] == 1 + 10**9 * (9 * 10**18 + 5) // (91 * 10**17 + 50)


# -- embedding near-duplicates --------------------------------------------------


def plain_links(rows, cosine=0.9):
    good = [i for i, r in enumerate(rows) if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    linked = {i: set() for i in range(len(rows))}
    norm = {i: np.sqrt(np.dot(rows[i][1], rows[i][1])) for i in good}
    for i in good:
        for j in good:
            if i < j and len(rows[i][1]) == len(rows[j][1]) and np.dot(rows[i][1], rows[j][1]) / (norm[i] * norm[j]) >= cosine:
                linked[i].add(j)
                linked[j].add(i)
    out, seen = [], set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, open_ = {i}, [i]
        while open_:
            new = linked[open_.pop()] - group
            group |= new
            open_ += new
        seen |= group
        smallest = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        out += [(rows[j][0], len(linked[j]), smallest, rows[j][0] == smallest) for j in group]
    return sorted(out, key=repr)


@pytest.mark.parametrize("length,blocks,leaf_rows,chunk_rows", [(16, 8, 8192, None), (16, 8, 30, 40), (10, 4, 50, 25), (3, 8, 20, 1000), (1, 8, 50, 50)])
@pytest.mark.parametrize("deep", [False, True])
def test_links_as_plain(spark, monkeypatch, length, blocks, leaf_rows, chunk_rows, deep):
    if deep:
        monkeypatch.setattr(subspaces, "fewest_copies", lambda points, dims, *rest: (len(dims) - 1).bit_length())
    points = cloud(length, 260, length, centres=40, noise=0.25)
    rows = [(i // 2 if i % 7 == 0 else i, p, 1) for i, p in enumerate(points)]
    rows += [(1000 + i, points[4], 2) for i in range(30)] + [(None, points[8], None), (None, None, None), (5, points[8], 1), (5, points[8], 1)]
    rows += [(2000 + i, [float(np.float32(2.5 * x)) for x in points[i]], 1) for i in range(10)] + [(2100, [0.0] * length, 1), (2101, [0.1] * (length + 1), 1)]
    found = subspaces.near_duplicates(vectors(spark, rows + BAD).repartition(3), blocks=blocks, leaf_rows=leaf_rows, chunk_rows=chunk_rows)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_links(rows + BAD)


def test_links_of_odd_tables(spark):
    assert subspaces.near_duplicates(vectors(spark, []).limit(0)).collect() == []
    found = subspaces.near_duplicates(vectors(spark, BAD)).orderBy("vec_id").collect()
    assert [tuple(r) for r in found] == [(r[0], 0, r[0], True) for r in BAD]
    # Squares that vanish or overflow have no direction.
    rows = [(1, [1e-200, 0.0], 1), (2, [1e-200, 0.0], 1), (3, [1e200, 0.0], 1), (4, [3.0, 0.0], 1), (5, [1.0, 0.0], 1)]
    found = subspaces.near_duplicates(vectors(spark, rows, "double")).orderBy("vec_id").collect()
    assert [tuple(r) for r in found] == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False)]


def test_every_close_pair_shares_a_block():
    """Pigeonhole, with integer coordinates: no pair at the threshold is lost, in vectors flat, spiky or close to an axis."""
    rng = np.random.default_rng(5)
    one = np.concatenate([rng.normal(size=(400, 32)), np.eye(32)[rng.integers(32, size=400)] + 0.01 * rng.normal(size=(400, 32))])
    away = rng.normal(size=one.shape)
    away -= (away * one).sum(axis=1)[:, None] / (one * one).sum(axis=1)[:, None] * one
    other = one / np.linalg.norm(one, axis=1)[:, None] * 0.9 + away / np.linalg.norm(away, axis=1)[:, None] * np.sqrt(1 - 0.81) * 0.999999
    width, blocks = 4, 8
    reach = int((subspaces.SCALE * np.sqrt((2 * 0.1 + 1e-9) / blocks) + np.sqrt(width) + 1e-6) ** 2)
    apart = subspaces.coordinates(one, 32) - subspaces.coordinates(other, 32)
    assert ((apart**2).reshape(-1, blocks, width).sum(axis=2).min(axis=1) <= reach).all()


@pytest.mark.parametrize("same", [True, False])
def test_boxes_find_all_pairs_once(monkeypatch, same):
    monkeypatch.setattr(subspaces, "BOX_ROWS", 16)
    points = np.random.default_rng(8).integers(-300, 300, size=(300, 4)).astype(np.int32)
    left, right = (np.arange(300), np.arange(300)) if same else (np.arange(120), np.arange(120, 300))
    found = [tuple(sorted(pair)) for x, y in subspaces.near_pairs(points, left, right, 110**2, same) for pair in zip(x.tolist(), y.tolist())]
    near = ((points[left][:, None].astype(int) - points[right][None]) ** 2).sum(axis=2) <= 110**2
    want = {tuple(sorted((int(left[i]), int(right[j])))) for i, j in zip(*np.nonzero(near)) if left[i] != right[j]}
    assert len(found) == len(set(found)) and set(found) == want


def test_leaves_reach_all_within_range():
    rng = np.random.default_rng(6)
    points = rng.integers(-300, 300, size=(400, 3)).astype(np.int32)
    dims, walls = subspaces.grow_tree(points[:200], 4)
    rows, leaves, home = subspaces.leaves_of(points, dims, walls, 60**2)
    own = dict(zip(rows[home].tolist(), leaves[home].tolist()))
    met = set(zip(rows.tolist(), leaves.tolist()))
    near = ((points[:, None].astype(int) - points[None]) ** 2).sum(axis=2) <= 60**2
    for i, j in zip(*np.nonzero(near)):
        assert (i, min(own[i], own[j])) in met
    assert len(met) == len(rows) and all(leaf <= own[row] for row, leaf in met)


def test_levels_follow_the_range():
    """A short range parts vectors into leaves; one that reaches across most walls does not."""
    rng = np.random.default_rng(9)
    points = subspaces.coordinates(rng.normal(size=(4000, 16)), 16)
    tree = subspaces.grow_tree(points, 6)
    near, far = (int((1024 * np.sqrt(2 * (1 - cosine)) + 4) ** 2) for cosine in (0.9995, 0.9))
    levels = [subspaces.fewest_copies(points[::4], *tree, reach, 1_000_000, 32_768) for reach in (near, far)]
    assert levels[0] >= 4 and levels[1] <= 1
