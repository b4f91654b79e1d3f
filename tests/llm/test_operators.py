"""Odd rows and brute-force comparisons of the training-data operators."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nbgauge.llm import decontaminate, fixity, hilbert, language, packing, quality, simhash, substrings, topk, toxicity
from tests.llm import brute

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "score string, block int, spans string, salt int, kept_text string, language string, shard int"
)


def documents(spark, texts, **more):
    """Rows of (doc_id, text) with further columns whose names the operators use themselves."""
    rows = [
        (i, t, more.get("lang", {}).get(i, "en"), more.get("source", {}).get(i, f"s{(i or 0) % 3}"), len(t) if t is not None else None,
         "x", 1, "y", 2, "z", "w", 3)
        for i, t in texts
    ]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "!!! 123 ..."), (6, "same text here"), (7, "same text here"), (7, "same text here"), (None, "no id at all")]


def sentence(rng, n, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rng():
    return random.Random(7)


# -- substring removal ----------------------------------------------------------


def removed(spark, rows, **options):
    found = substrings.remove_repeats(documents(spark, rows), **options)
    names = found.columns
    return found, sorted((r[0], r[12], r[13], r[14]) for r in found.select(*[f"`{c}`" for c in names]).collect() if r[0] is not None)


def test_repeats_as_brute_force(spark, rng, monkeypatch):
    passage, other = sentence(rng, 45), sentence(rng, 25)
    rows = []
    for i in range(60):
        parts = [sentence(rng, rng.randrange(0, 60))]
        if i % 3 == 0:
            parts.append(passage if i % 2 else " ".join(passage.split()[rng.randrange(10) :]))
        if i % 4 == 0:
            parts.append(other)
        if i % 7 == 0:
            parts.append("tick " * rng.randrange(15, 60))
        rng.shuffle(parts)
        rows.append((i, rng.choice([" ", "\n", "\x0b"]).join(parts)))
    rows += [(100, None), (101, ""), (102, " x y " * 40), (103, rows[0][1]), (104, passage)]
    want = brute.repeats(rows)
    assert removed(spark, rows, block_rows=7)[1] == want
    # The same when every anchor counts as one of very many blocks.
    monkeypatch.setattr(substrings, "HOT_BLOCKS", 0)
    assert removed(spark, rows, block_rows=7)[1] == want
    assert sum(w[2] for w in want) > 100


def test_repeats_odd_rows(spark):
    found, rows = removed(spark, ODD)
    assert found.columns[:12] == documents(spark, []).columns and found.columns[-1] == "kept_text_"
    assert found.count() == len(ODD) and all(r[2] == 0 for r in rows)
    assert substrings.remove_repeats(documents(spark, [])).count() == 0
    long = " ".join(str(i) for i in range(30))
    again = substrings.remove_repeats(documents(spark, [(1, long), (1, long), (2, "a " + long + " b")])).collect()
    # Equal rows are one document, listed twice.
    assert sorted((r.doc_id, r.n_removed, r.kept_text_) for r in again) == [(1, 0, long), (1, 0, long), (2, 30, "a b")]


def test_automaton_matches():
    automaton = substrings.Automaton()
    rng = np.random.default_rng(1)
    texts = [list(rng.integers(0, 3, 30)) for _ in range(20)]
    for number, text in enumerate(texts):
        joined = [tuple(t) for t in texts[:number]]
        for end, length in enumerate(automaton.matches(text), 1):
            def occurs(n):
                piece = tuple(text[end - n : end])
                return any(t[i : i + n] == piece for t in joined for i in range(len(t) - n + 1))

            assert (length == 0 or occurs(length)) and (length == end or not occurs(length + 1))
        automaton.add(text)


# -- SimHash ----------------------------------------------------------------------


def test_simhash_as_brute_force(spark, rng):
    base = sentence(rng, 120)
    rows = [(i, sentence(rng, 40)) for i in range(30)]
    for i in range(30, 60):
        words = base.split()
        words[rng.randrange(len(words))] = "other"
        rows.append((i, " ".join(words)))
    rows += [(60, None), (61, ""), (62, "One TWO"), (63, "one two"), (64, "É é"), (65, base), (66, base)]
    marks = [(i, brute.simhash(t)) for i, t in rows]
    want = brute.near_groups(marks)
    for node_rows in (4000, 3):
        found = simhash.near_duplicates(documents(spark, rows), node_rows).collect()
        assert {r.doc_id: r.component_id for r in found} == want
    assert {r.doc_id: r.fingerprint % 2**64 for r in found} == dict(marks)


def test_simhash_odd_rows(spark):
    found = simhash.near_duplicates(documents(spark, ODD)).collect()
    assert len(found) == len(ODD)
    by_id = {r.doc_id: r for r in found}
    assert by_id[1].fingerprint == by_id[3].fingerprint == 0 and by_id[3].component_id == 1
    assert by_id[7].component_id == 6
    assert by_id[None].component_id is None
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_trie_between_two_sets():
    rng = np.random.default_rng(3)
    left, right = rng.integers(0, 2**63, 200, dtype=np.uint64), rng.integers(0, 2**63, 200, dtype=np.uint64)
    right[:50] = left[:50] ^ np.uint64(0b1011 << 20)
    links = simhash.trie_links(left, right)
    assert {frozenset(map(int, pair)) for pair in links} == {frozenset((int(a), int(b))) for a, b in zip(left[:50], right[:50])}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in simhash.components(links).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# -- shards -----------------------------------------------------------------------


def test_hilbert_index_is_a_curve(spark):
    points = spark.range(16 * 16 * 16).selectExpr("int(id % 16) x", "int(id div 16 % 16) y", "int(id div 256) z")
    from pyspark.sql import functions as F

    rows = hilbert.with_hilbert_index(points, [F.col("x"), F.col("y"), F.col("z")], 4).orderBy("hilbert").collect()
    assert [r.hilbert for r in rows] == list(range(4096))
    # Each step of the curve goes to a neighbouring cell.
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(rows, rows[1:]))


def test_shards_as_plain_sorting(spark, rng):
    rows = ODD + [(i, sentence(rng, rng.randrange(1, 90))) for i in range(20, 150)] + [(500, "hot")] * 70
    found = hilbert.hilbert_shards(documents(spark, rows), shards=7).collect()
    keys = [(brute.hilbert_index([r.cell_0, r.cell_1, r.cell_2], 5), r.text_crc32, r.doc_id) for r in found]
    assert [k[0] for k in keys] == [r.hilbert for r in found]
    ordered = sorted(keys, key=lambda k: [-1 if v is None else v for v in k])
    shards = [at * 7 // len(rows) for at in range(len(rows))]
    slots = [shards[:at].count(s) for at, s in enumerate(shards)]
    assert sorted(zip(keys, [(r.shard, r.slot) for r in found]), key=repr) == sorted(zip(ordered, zip(shards, slots)), key=repr)


def test_shards(spark, rng):
    rows = ODD + [(i, sentence(rng, rng.randrange(1, 90))) for i in range(20, 150)] + [(500, "hot")] * 70
    found = hilbert.hilbert_shards(documents(spark, rows), shards=7).collect()
    assert len(found) == len(rows)
    sizes = [sum(r.shard == s for r in found) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    for shard in range(7):
        mine = sorted((r for r in found if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        assert [r.hilbert for r in mine] == sorted(r.hilbert for r in mine)
    texts = {i: t for i, t in rows}
    for r in found:
        text = texts[r.doc_id]
        assert r["size"] == len((text or "").encode()) + 16
        assert r.text_crc32 == (None if text is None else zlib.crc32(text.encode()))
        assert r.law == "rows" and r.grown_shard is None
    assert hilbert.hilbert_shards(documents(spark, [])).count() == 0


def test_shards_prune(spark):
    from pyspark.sql import functions as F

    def drawn(n, k):
        return F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n))

    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.concat(F.lit("s"), drawn(16, 1)).alias("source"),
        F.concat(F.lit("l"), drawn(8, 2)).alias("lang"), drawn(1000, 3).alias("n_chars"),
    )
    placed = hilbert.hilbert_shards(docs, shards=32).join(docs.drop("text"), "doc_id")
    zones = hilbert.zone_map(placed, ["source", "lang", "n_chars"]).collect()
    for column, value in (("source", "s5"), ("lang", "l3"), ("n_chars", 500)):
        assert sum(r[f"{column}_min"] <= value <= r[f"{column}_max"] for r in zones) <= 24


# -- packing ----------------------------------------------------------------------


def plain_pack(items, capacity):
    bins, places = [], []
    for size, source, cluster in items:
        fits = [
            (b["left"], n) for n, b in enumerate(bins)
            if b["left"] >= size and (source < 0 or source not in b["sources"]) and (cluster < 0 or cluster not in b["clusters"])
        ]
        if fits:
            number = min(fits)[1]
        else:
            number = len(bins)
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
        b = bins[number]
        places.append((number, capacity - b["left"]))
        b["left"] -= size
        b["sources"].add(source)
        b["clusters"].add(cluster)
    return places


def test_best_fit_as_plain_search(rng):
    for _ in range(30):
        items = sorted(((rng.randrange(0, 50), rng.randrange(-1, 6), rng.randrange(-1, 30)) for _ in range(120)), reverse=True)
        assert packing.pack(items, 100) == plain_pack(items, 100)


def test_packing(spark, rng):
    rows = ODD + [(i, sentence(rng, rng.randrange(0, 70))) for i in range(20, 120)] + [(200, sentence(rng, 405))]
    docs = documents(spark, rows, source={i: "hot" for i in range(20, 60)} | {3: None})
    found = packing.best_fit(docs, capacity=100, group_rows=40).collect()
    words = {i: len(brute.words(t)) for i, t in rows}
    sources = {r.doc_id: r.source for r in docs.collect()}
    assert {r.doc_id for r in found} == set(words)
    assert sum(r.n_words for r in found) == sum(len(brute.words(t)) for _, t in rows)
    assert [(r.piece, r.first_word, r.n_words) for r in sorted(found, key=lambda r: r.piece) if r.doc_id == 200] == [
        (0, 0, 100), (1, 100, 100), (2, 200, 100), (3, 300, 100), (4, 400, 5)
    ]
    bins = {}
    for r in found:
        bins.setdefault(r.bin, []).append(r)
    for mine in bins.values():
        assert sum(r.n_words for r in mine) <= 100
        at = 0
        for r in sorted(mine, key=lambda r: (r.bin_offset, r.n_words)):
            assert r.bin_offset == at
            at += r.n_words
        used = [sources[r.doc_id] for r in mine if sources[r.doc_id] is not None]
        assert len(used) == len(set(used))
        assert sum(r.doc_id in (6, 7) for r in mine) <= 1
    assert packing.best_fit(documents(spark, [])).count() == 0


# -- top-k ------------------------------------------------------------------------


def plain_top(rows, k, every):
    ints = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ints.setdefault(i, []).append([int(np.floor(256 * float(x))) for x in v])
    out = []
    for q in (i for i in ints if i % every == 0):
        mine = min(ints[q])
        scores = [(-sum(a * b for a, b in zip(mine, v)), i) for i, vs in ints.items() if i != q for v in vs if len(v) == len(mine)]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_top_k(spark, rng):
    rows = [(i, [float(np.float32(rng.uniform(-1, 1))) for _ in range(8)]) for i in range(120)]
    rows += [(i, rows[3][1]) for i in range(200, 240)]  # ties
    rows += [(300, None), (301, [1.0, None] * 4), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, rows[0][1]), (310, [1.0, 2.0]), (311, [])]
    rows += [(320, [2.0**40] * 8), (4, rows[5][1])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")
    want = plain_top(rows, 5, 10)
    for block in (2048, 4):
        found = topk.top_k(table, 5, 10, query_block=block, rows=16)
        assert sorted(tuple(r) for r in found.collect()) == want
    assert topk.top_k(table.where("false")).count() == 0
    few = topk.top_k(table.where("vec_id in (0, 1, 2)"), 5, 10)
    assert [r["rank"] for r in few.collect()] == [1, 2]


# -- fixity -----------------------------------------------------------------------


def test_fixity_locates_damage(spark):
    rows = [(i // 40, i % 40 * 70_000, hashlib.sha256(b"%d" % i).hexdigest(), i) for i in range(200)]
    schema = "archive long, offset long, digest string, record_id long"
    odd = [(None, None, None, None), (9, 5, "a", 1000), (9, 5, "a", 1000)]
    left = spark.createDataFrame(rows + odd, schema).selectExpr("*", "1 AS node", "2 AS level")
    copy = [r for r in rows if r[3] != 17]
    copy[60] = (*copy[60][:2], "x", copy[60][3])
    right = spark.createDataFrame(copy + [(2, 11, "new", 2000)] + odd[:2], schema)
    found = sorted((r.archive, r.offset, r.status) for r in fixity.audit(left, right).collect())
    assert found == sorted([(0, 17 * 70_000, "missing"), (rows[61][0], rows[61][1], "changed"), (2, 11, "extra"), (9, 5, "changed")])
    assert fixity.audit(left, left).count() == 0
    assert fixity.audit(left, left.where("false")).count() == len(rows) + 2
    assert fixity.audit(left.where("false"), left.where("false")).count() == 0


def test_records_lie_end_to_end(spark):
    rows = spark.createDataFrame([(i, 100 + i % 7) for i in range(300)] + [(5, 105)] * 40 + [(None, 3)], "id long, length long")
    found = sorted((r.archive, r.offset, r.length) for r in fixity.place_records(rows, "id", "length", 5000).collect())
    at = 0
    for archive, offset, length in found:
        assert archive * 5000 + offset == at
        at += length
    assert len(found) == 341


# -- learned operators ------------------------------------------------------------


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_language(spark, rng):
    syllables = {"aa": "ka to mi re", "bb": "zu pl xo qw", "cc": "жа ло ти мы"}

    def text(lang, n):
        return " ".join("".join(rng.choice(syllables[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))

    rows = [(i, text(lang, 40)) for i in range(240) for lang in [list(syllables)[i % 3]]]
    langs = {i: list(syllables)[i % 3] for i in range(240)}
    mixed = text("aa", 30) + " " + text("bb", 20)
    docs = documents(spark, rows + [(1000 + i if i else None, t) for i, t in ODD] + [(2000, mixed), (2001, "42 " + text("cc", 3))], lang=langs | {2000: None, 1001: None})
    found = {r.doc_id: r for r in language.predict_languages(docs.where("doc_id < 240 OR doc_id >= 1000 AND doc_id <> 1009")).collect()}
    assert all(found[i].lang_pred == langs[i] and found[i].score == 1 for i in range(240) if i in found)
    assert [s.lang for s in found[2000].spans] == ["aa", "bb"] and found[2000].spans[0].end == 30 and found[2000].score == 0.6
    assert found[2001].lang_pred == "cc" and found[2001].spans[0].start == 1
    for i in (1001, 1002, 1003, 1005):
        assert (found[i].lang_pred, found[i].score, found[i].spans) == ("und", 0.0, [])
    assert {i: r.held_out for i, r in found.items()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in found}
    assert language.predict_languages(documents(spark, [])).count() == 0
    only = language.predict_languages(documents(spark, ODD, lang={i: None for i, _ in ODD})).collect()
    assert len(only) == len(ODD) and {r.lang_pred for r in only} == {"und"}


def test_viterbi_as_plain_search():
    rng = np.random.default_rng(5)
    texts = [-6 * rng.random((n, 3)) for n in (9, 7, 4, 1)]
    for penalty in (0.5, 3.0):
        for text, path in zip(texts, language.best_paths(texts, penalty)):
            paths = np.indices((3,) * len(text)).reshape(len(text), -1).T
            values = text[np.arange(len(text)), paths].sum(axis=1) - penalty * (paths[:, 1:] != paths[:, :-1]).sum(axis=1)
            assert list(path) == list(paths[values.argmax()])


def test_forward_backward_as_plain_sum():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 1, 5])
    bad, change = rng.normal(size=9), rng.normal(size=(2, 2))
    marginal, pairs, log_z = quality.forward_backward(bad, change, sizes)
    want_pairs, at = np.zeros((2, 2)), 0
    for k, n in enumerate(sizes):
        paths = np.indices((2,) * n).reshape(n, -1).T
        weights = np.exp([sum(bad[at + i] * s for i, s in enumerate(p)) + sum(change[a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert log_z[k] == pytest.approx(np.log(weights.sum()))
        assert marginal[at : at + n] == pytest.approx((weights[:, None] * paths).sum(0) / weights.sum())
        for p, w in zip(paths, weights / weights.sum()):
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += w / n
        at += n
    assert pairs == pytest.approx(want_pairs)


def test_quality(spark, rng):
    def good():
        return "\n".join(sentence(rng, 12).capitalize() + "." for _ in range(rng.randrange(1, 8)))

    def bad():
        line = rng.choice(["BUY NOW!! ", "a | b | c | ", "go go go go "])
        return "\n".join([sentence(rng, 6), *[line * rng.randrange(3, 9) for _ in range(5)]])

    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(400)]
    labels = labels_of(spark, [(i, int(i % 4 != 0), 0) for i in range(400)] + [(3, 1, 0), (None, 1, 0), (5000, 0, 0), (9, None, None)])
    docs = documents(spark, rows + [(1000 + (i or 0), t) for i, t in ODD])
    found = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([found[i].predicted == int(i % 4 != 0) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    assert found[1001].score == found[1002].score
    assert quality.score_quality(documents(spark, []), labels).count() == 0
    none = quality.score_quality(documents(spark, ODD), labels.where("false")).collect()
    assert len(none) == len(ODD) and {r.score for r in none} == {0.5}
    model = quality.learn_quality(docs, labels)
    lines = quality.line_labels(documents(spark, [(1, f"{sentence(rng, 12)}.\n" + "BUY NOW!! " * 8)]), model).orderBy("line").collect()
    assert len(lines) == 2 and lines[1].p_good < 0.5


def test_toxicity(spark, rng):
    def text(toxic):
        words = sentence(rng, rng.randrange(10, 60), 3000).split()
        for _ in range(rng.randrange(1, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Nasty,", "vile", "rottenness", "rottenly"]))
        return " ".join(words)

    rows = [(i, text(i % 3 == 0)) for i in range(500)]
    labels = labels_of(spark, [(i, 1, int(i % 3 == 0)) for i in range(500)] + [(0, 1, 0), (None, 1, 1)])
    docs = documents(spark, rows + [(1000 + (i or 0), t) for i, t in ODD] + [(2000, "vile nasty vile nasty"), (2001, sentence(rng, 60) + " vile")])
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([found[i].toxic == int(i % 3 == 0) for i in held]) > 0.97
    assert all(0 <= r.severity <= 3 and 0 <= r.score <= 1 and 0 <= r.grade <= 3 for r in found.values())
    assert found[2000].severity > found[2001].severity > found[1006].severity
    assert found[1001].toxic == found[1002].toxic == 0
    assert toxicity.score_toxicity(documents(spark, []), labels).count() == 0
    assert {r.toxic for r in toxicity.score_toxicity(documents(spark, ODD), labels.where("false")).collect()} == {0}


def test_thresholds_stay_in_order():
    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    grades = np.digitize(x + 0.1 * rng.normal(size=400), [0, 0.7, 1.4])
    weights, thresholds = toxicity.fit_ordinal(np.arange(400), np.zeros(400, int), x, grades, 1)
    assert weights[0] > 0 and (np.diff(thresholds) > 0).all()


# -- decontamination ----------------------------------------------------------------


def test_leaks(spark):
    item = "A train leaves Paris at 10 am and travels 300 km towards Berlin, while another leaves at 12 and travels 450 km. When do they meet?"
    again = "A train leaves Madrid at 9 am and travels 270 km towards Oslo, while another leaves at 11 and travels 520 km. When do they meet?"
    twisted = "A train leaves Madrid at 9 am and travels 270 km towards Oslo, while another leaves at 11 and travels 520 km."
    benchmark = spark.createDataFrame(
        [(1, item, "x"), (1, item, "x"), (2, "too short", "x"), (3, None, "x"), (None, item, "x"), (4, "", "x"),
         (5, "Add 5 and 5 and then add 5 to what is left of the sum of both", "x")],
        "item_id long, text string, leaks string",
    )
    rows = ODD + [
        (10, f"Some words before. {item} And after."), (11, f"Before it. {again}"), (12, "A train leaves the station and nobody knows when."),
        (13, "7 8 9 10 11 12 13 14 15 16 17 18"), (14, f"before {twisted}"),
        (17, f"Before it. {item.upper()}"), (18, f"before it {item.lower()}"), (19, f"before it {item.title()}"),
        (15, "so Add 5 and 9 and then add 2 to what is left of the sum of both"), (16, "so Add 8 and 8 and then add 8 to what is left of the sum of both"),
    ]
    found = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(documents(spark, rows), benchmark).collect()}
    # Document 15 has other numbers where the item has one number thrice.
    assert set(found) == {(10, 1), (11, 1), (14, 1), (16, 5), (17, 1), (18, 1), (19, 1)}
    assert {found[i, 1].kind for i in (17, 18, 19)} == {"verbatim"}
    assert found[10, 1].kind == "verbatim" and found[11, 1].kind == "reparameterised" and found[11, 1].slots > 3
    kept = decontaminate.without_leaks(documents(spark, rows), benchmark)
    assert kept.columns == documents(spark, []).columns and kept.count() == len(rows) - 7
    assert decontaminate.leaks(documents(spark, []), benchmark).count() == 0
    assert decontaminate.leaks(documents(spark, rows), benchmark.where("false")).count() == 0


def test_leaks_of_a_large_benchmark(spark, rng):
    """The join gives what the lookup gives, also where documents, items and item ids repeat."""
    vocabulary = [f"w{i}" for i in range(300)] + ["Paris", "Rome", "7", "12", "km", "kg"]
    items = [(i % 25, " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 9, 15, 30])))) for i in range(30)] * 2
    benchmark = spark.createDataFrame(items + [(26, None), (None, "w1 w2 w3 w4 w5"), (27, "")], "item_id long, text string")
    rows = list(ODD)
    for i in range(40):
        item = rng.choice(items)[1]
        changed = " ".join(rng.choice(["3", "Oslo"]) if w in ("7", "Paris") else w for w in item.split())
        rows.append((100 + i % 30, " ".join(rng.choices(vocabulary, k=10)) + " " + rng.choice([item, changed, item.upper()]) + " end"))
    docs = documents(spark, rows + rows[-3:]).withColumn("leaks", F.lit("x")).withColumn("row", F.lit(1))
    for column in ("leaks", "found_"):
        looked_up = decontaminate.with_leaks(docs, benchmark, column)
        joined = decontaminate.with_leaks(docs, benchmark, column, shipped_items=1)
        assert set(joined.columns) == set(looked_up.columns)
        one, two = [sorted(repr(r) for r in d.select(*looked_up.columns).collect()) for d in (looked_up, joined)]
        assert one == two and sum("verbatim" in r for r in one) > 20
    assert decontaminate.with_leaks(docs.limit(0), benchmark, "found_", shipped_items=1).count() == 0
    assert decontaminate.leaks(docs, benchmark, shipped_bytes=10).count() == decontaminate.leaks(docs, benchmark).count()


def held(items, texts):
    """(item, kind) found in each text, looked up."""
    templates = decontaminate.Templates(list(enumerate(items)))
    templates.prepare()
    return [[(r["item_id"], r["kind"]) for r in found] for found in templates.find_all(pa.array(texts, pa.large_string()))]


def test_leaks_as_plain_search():
    """Random items, whole, with other slots and cut off, against a pattern per item."""
    draw = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("bal", "cor", "dun", "fel", "gim", "hob", "jat", "kel") for b in ("ta", "rin", "mo", "sel", "pud", "vik", "zan")]
    names = ["Anna", "Boris", "Clara", "Denis", "Emma", "Felix"]

    def item():
        words = draw.choices(vocabulary, k=draw.randrange(14, 30))
        for place, slot in zip(draw.sample(range(1, len(words) - 1), 4), ("number", "number", "name", "number")):
            words[place] = str(draw.randrange(2, 900)) if slot == "number" else draw.choice(names)
        return " ".join(words)

    def others(text):
        """Other numbers and another name, the same for the same."""
        new = {}
        for w in text.split():
            if w.isdigit():
                new.setdefault(w, str(1000 + len(new) * 37))
            elif w in names:
                new.setdefault(w, draw.choice([n for n in names if n != w]))
        return " ".join(new.get(w, w) for w in text.split())

    items = [item() for _ in range(25)]
    texts = []
    for text in items:
        for body in (text, others(text), " ".join(text.split()[: len(text.split()) // 3]), ""):
            texts.append(" ".join([*draw.choices(vocabulary, k=draw.randrange(1, 30)), body, *draw.choices(vocabulary, k=draw.randrange(1, 30))]))
    want = [brute.template_matches(items, names, t) for t in texts]
    assert sum(kind == "verbatim" for found in want for _, kind in found) == sum(kind == "reparameterised" for found in want for _, kind in found) == 25
    assert [sorted(x) for x in held(items, texts)] == want


def test_leaks_next_to_variants():
    """A variant of an item in the same document hides neither the item nor the variant."""
    item = "A shop sells {} boxes of apples every day and each of these boxes holds {} apples, so how many apples are sold in {} days?"
    told, one, two = item.format(48, 12, 7), item.format(50, 30, 9), item.format(81, 24, 3)
    texts = [f"{told} Then. {one}", f"{one} {told}", f"{one} And now. {told} {two}", f"{one} {two}", f"{one} {two} {item.format(6, 5, 4)}"]
    assert held([told], texts) == [[(0, "verbatim")]] * 3 + [[(0, "reparameterised")]] * 2
    # The standing is that of the item, and one broken by other words is one standing.
    templates = decontaminate.Templates([(0, told)])
    templates.prepare()
    assert templates.find(texts[1])[0]["first_word"] == len(one.split())
    words = told.split()
    broken = " ".join([*words[:12], "with", "a", "long", "remark", *words[12:]])
    assert held([told], [f"{broken} {one}", f"{broken} {broken}"]) == [[(0, "verbatim")]] * 2


def test_leaks_with_other_names_and_joined_units():
    names = "{0} went to the market with all of his friends. {0} bought nine loaves of bread for the party. {0} then gave five loaves back to the baker."
    money = "The old farmer sold ${} worth of corn and {}kg of wheat, then drove {}km home to count what was left of it."
    runs = "On the first day {} walked along the river, and on the second day {} came back with three big fish for dinner."
    items = [names.format("Tom"), money.format(5, 20, 13), runs.format("John", "John")]
    texts = [names.format("Ann"), money.format(7, 35, 40), money.format(7, 35, 40).replace("35kg", "35 kg").replace("$7", "€7"), runs.format("Mary Ann", "Mary Ann")]
    assert held(items, texts) == [[(0, "reparameterised")], [(1, "reparameterised")], [(1, "reparameterised")], [(2, "reparameterised")]]
    assert held(items, [names.format("Tom"), runs.format("John", "John").upper()]) == [[(0, "verbatim")], [(2, "verbatim")]]


def test_leaks_of_items_without_telling_windows(spark):
    """Short, numeric and unspaced items are found verbatim; unspaced ones also with other numbers."""
    chinese = "小明有5个苹果，他又买了8个苹果，请问他现在一共有多少个苹果？"
    items = ["Compute 12/5 of 30 kg", chinese, "1 2 3 4 5 6 7 8 9 10 11 12 13 and 14"]
    texts = [
        "First: compute 12/5 of 30 kg. Then stop.", "compute 12/6 of 30 kg", f"题目：{chinese}答案", chinese.replace("5", "7").replace("8", "9"),
        "so 1 2 3 4 5 6 7 8 9 10 11 12 13 and 14 end", "so 1 2 3 4 5 6 7 8 9 10 11 12 13 and 15",
    ]
    want = [[(0, "verbatim")], [], [(1, "verbatim")], [(1, "reparameterised")], [(2, "verbatim")], []]
    assert held(items, texts) == want
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for shipped in (20_000, 1):
        found = decontaminate.leaks(documents(spark, list(enumerate(texts))), benchmark, shipped_items=shipped).collect()
        assert {(r.doc_id, r.item_id, r.kind) for r in found} == {(i, *r) for i, rows in enumerate(want) for r in rows}


# -- pipeline -----------------------------------------------------------------------


def test_pipeline_stages(spark, rng, tmp_path):
    langs = ["en", "fr"]
    texts = {i: " ".join(rng.choice(["ka", "to", "mi"] if i % 2 else ["zu", "plo", "xwe"]) + str(rng.randrange(10**6)) + "q" for _ in range(60)) for i in range(80)}
    item = "unusual words of a question that nobody would write by chance anywhere at all today"
    rows = list(texts.items()) + [
        (100, texts[0]), (101, texts[1]), (102, None), (103, "12 34"), (104, texts[3] + " " + item),
        (105, " ".join(texts[5].split()[:25]) + " " + " ".join(f"to{k}q" for k in range(40))),
    ]
    docs = documents(spark, rows, lang={i: langs[i % 2] for i, _ in rows})
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
    left = {r.doc_id: r for r in kept.collect()}
    # Copies, texts without letters and the leaked item are gone; a repeated passage is cut out.
    assert set(left) == set(texts) | {105}
    assert all(left[i].text == t and left[i].n_chars == len(t) for i, t in texts.items())
    assert left[105].text == " ".join(f"to{k}q" for k in range(40)) and left[105].n_chars == len(left[105].text)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(left)


@pytest.mark.parametrize("name", ["documents"])
def test_pipeline_of_no_documents(spark, tmp_path, name):
    documents(spark, []).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def plain_groups(texts):
    """Groups of texts whose fingerprints link within three bits, over all pairs."""
    marks = [simhash.fingerprint(t) for t in texts]
    parent = list(range(len(texts)))
    for i, a in enumerate(marks):
        for j, b in enumerate(marks[:i]):
            if (a ^ b).bit_count() <= 3:
                old, new = parent[i], parent[j]
                parent = [new if p == old else p for p in parent]
    return {frozenset(i for i, p in enumerate(parent) if p == q) for q in set(parent)}


def test_pipeline_drops_near_copies_by_fingerprint(spark, rng, tmp_path):
    """Groups of fingerprints within three bits, as a search over all pairs finds them."""
    texts = [sentence(rng, rng.randrange(1, 130), 2000) for _ in range(20)]
    for base in list(texts):
        for changes in (1, 1, 2, 3):
            words = base.split()
            for _ in range(changes):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
            texts.append(" ".join(words))
    long = sentence(rng, 3000, 5000).split()
    texts += [" ".join(long), " ".join([*long[:100], "x", *long[101:200], "y", *long[201:]]), "", None, "One two", "one  TWO"]
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, list(enumerate(texts))), str(tmp_path))
    assert kept.columns == documents(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in plain_groups(texts))


def test_simhash_by_its_parameters(spark, rng):
    """Other shingle lengths and budgets, against all pairs."""
    texts = [sentence(rng, 30, 300) for _ in range(30)]
    texts += [" ".join([*t.split()[:-1], "z"]) for t in texts]
    for size, budget in ((1, 0), (2, 1), (5, 2)):
        marks = [simhash.fingerprint(t, size) for t in texts]
        found = simhash.near_duplicates(documents(spark, list(enumerate(texts))), size=size, budget=budget).collect()
        assert all(r.fingerprint % (1 << 64) == marks[r.doc_id] for r in found)
        group = {r.doc_id: r.component_id for r in found}
        linked = [(i, j) for i in range(len(texts)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= budget]
        assert all(group[i] == group[j] for i, j in linked)
        assert len(set(group.values())) >= len(texts) - len(linked)
    with pytest.raises(ValueError):
        simhash.near_duplicates(documents(spark, [(1, "a")]), budget=4)


def test_pipeline_keeps_rows_by_text_not_by_id(spark, rng, tmp_path):
    """Different texts without an id, or with one id, are different documents; what stays does not depend on the run."""
    texts = [sentence(rng, 40, 3000) for _ in range(12)]
    rows = [(None, t) for t in texts[:6]] + [(3, texts[6]), (7, texts[7]), (7, texts[6]), (8, texts[8]), (8, texts[8]), (None, texts[7])]
    assert len(plain_groups(texts)) == len(texts)
    docs = documents(spark, rows)
    other = docs.where("doc_id = 8").withColumn("source", F.lit("elsewhere"))
    kept = [
        sorted(map(repr, corpus_pipeline.drop_near_duplicates(spark, d, str(tmp_path)).collect()))
        for d in (docs.union(other), other.union(docs).repartition(3))
    ]
    assert kept[0] == kept[1]
    found = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in found) == sorted([(0, t) for t in texts[:6]] + [(3, texts[6]), (7, texts[7]), (8, texts[8])])


def test_text_without_spaces_counts_whole(spark):
    """A beginning in one language does not decide for what follows it."""
    greek, latin = "καλημερα", "goodmorning"
    learned = [(i, " ".join([greek, latin][i % 2] for _ in range(20)), ["el", "en"][i % 2]) for i in range(40)]
    model = language.fit_languages(spark.createDataFrame(learned, "doc_id long, text string, lang string"))
    texts = [(1, greek * 8 + latin * 60, None), (2, latin * 8 + "\t" + greek * 60, None), (3, latin, None)]
    rows = language.predict_languages(spark.createDataFrame(texts, "doc_id long, text string, lang string"), model).collect()
    found = {r.doc_id: r for r in rows}
    assert found[1].lang_pred == "en" and 0.8 < found[1].score < 1
    assert [(s.start, s.end, s.lang) for s in found[1].spans] == [(0, 1, "el"), (0, 1, "en")]
    assert found[2].lang_pred == "el" and [(s.start, s.end, s.lang) for s in found[2].spans] == [(0, 1, "en"), (1, 2, "el")]
    assert (found[3].lang_pred, found[3].score) == ("en", 1.0)


def test_more_languages_than_a_full_table_holds(spark, rng):
    """Every language is learned; the sparse table scores as the full one does."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:03d}": ["".join(rng.choice(letters) for _ in range(6)) for _ in range(8)] for i in range(300)}
    # The last language has the fewest rows.
    rows = [(i * 4 + k, " ".join(rng.choices(words[lang], k=12)), lang) for i, lang in enumerate(sorted(words)) for k in range(4 if lang != "l299" else 3)]
    rows = [(next(j for j in range(10 * i, 10 * i + 10) if zlib.crc32(str(j).encode()) % 3 != 1), t, lang) for i, (_, t, lang) in enumerate(rows)]
    model = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 300 and model.logs.full is None
    asked = [(i, " ".join(rng.choices(words[lang], k=12)), None) for i, lang in enumerate(sorted(words))]
    found = language.predict_languages(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model).collect()
    assert sum(r.lang_pred == f"l{r.doc_id:03d}" for r in found) >= 295
    assert next(r for r in found if r.doc_id == 299).lang_pred == "l299"
    counts = [(i, np.unique(np.array([rng.randrange(language.BUCKETS) for _ in range(50)])), None) for i in range(130)]
    counts = [(i, b, np.arange(1, len(b) + 1)) for i, b, _ in counts]
    sparse = language.GramLogs.of(counts, 130)
    language.GramLogs.FULL, before = 130, language.GramLogs.FULL
    try:
        full = language.GramLogs.of(counts, 130)
    finally:
        language.GramLogs.FULL = before
    buckets = np.array([rng.randrange(language.BUCKETS) for _ in range(200)] + [int(b) for _, bs, _ in counts[:20] for b in bs])
    owner = np.sort(np.array([rng.randrange(40) for _ in buckets]))
    assert full.full is not None and np.allclose(sparse.totals(buckets, owner, 40), full.totals(buckets, owner, 40), atol=1e-3)


def test_texts_with_a_common_beginning_fill_all_cells(spark, rng):
    """Thirty equal bytes in front do not put a dimension into one cell."""
    rows = [(i, sentence(rng, 3)) for i in range(600)]
    sources = {i: f"https://www.example.org/a/very/common/path/{rng.randrange(400):04d}" for i, _ in rows}
    placed = hilbert.hilbert_shards(documents(spark, rows, source=sources), dimensions=("source", "n_chars"), shards=16, bits=4)
    sizes = [r["count"] for r in placed.groupBy("cell_0").count().collect()]
    assert len(sizes) == 15 and max(sizes) <= 60
    # A value that fills most rows has its cell, the others still spread over theirs.
    sources = {i: "same" if i % 3 else s for i, s in sources.items()}
    placed = hilbert.hilbert_shards(documents(spark, rows, source=sources), dimensions=("source", "n_chars"), shards=16, bits=4)
    assert placed.select("cell_0").distinct().count() >= 5
    where = placed.join(documents(spark, rows, source=sources).select("doc_id", "source"), "doc_id")
    ranges = hilbert.zone_map(where, ["source"]).collect()
    assert sum(r.source_min <= "https://www.example.org/a/very/common/path/0003" <= r.source_max for r in ranges) < len(ranges)


def test_walls_from_a_part_of_many_texts(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "WALL_VALUES", 300)
    df = spark.range(3000).select(F.concat(F.lit("common beginning "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("v"))
    df = df.union(spark.range(1500).select(F.lit("common beginning 0").alias("v")))
    walls = hilbert.text_walls(df, F.col("v"), 14)
    assert walls == sorted(walls) and walls[:4] == ["common beginning 0"] * 4 and len(set(walls)) >= 9


@pytest.mark.parametrize("window", [1, 2, 6, 40, 68, 69, 100, 200])
def test_windows_of_any_length(spark, rng, window):
    words = [f"w{rng.randrange(6)}" for _ in range(230)]
    passage = sentence(rng, 210, 3000)
    rows = [(1, " ".join(words)), (2, " ".join(words[5:] + words[:40])), (3, passage), (4, f"x {passage} y"), (5, sentence(rng, 50, 3) + " " + passage), (6, "")]
    _, got = removed(spark, rows, window=window)
    assert got == [(d, n, r, h) for d, n, r, h in brute.repeats(rows, window)]


def test_removal_without_texts(spark):
    found = substrings.remove_repeats(documents(spark, [(1, "a b c")]), keep_text=False)
    assert "text" not in found.columns and "kept_text_" not in found.columns and found.count() == 1


def test_bins_do_not_depend_on_partitions(spark, rng):
    rows = [(i if i % 10 else None, sentence(rng, rng.randrange(1, 60), 50)) for i in range(200)] + [(7, "same row again")] * 50
    docs = documents(spark, rows)
    bins = [
        sorted(map(repr, packing.best_fit(d, capacity=100, group_rows=40).collect())) for d in (docs, docs.repartition(5), docs.orderBy(F.desc("doc_id")))
    ]
    assert bins[0] == bins[1] == bins[2] and len(bins[0]) == len(rows)


LONG = [(900, "x" * 1_000_000), (901, "word " * 40_000), (902, "line of text\n" * 20_000), (903, "ab cd " * 20_000 + "end")]


def test_very_long_texts(spark, rng):
    """One long word, one word many times, many lines: whole, as brute force has it."""
    rows = [(i, t) for i, t in ODD if i not in (7, None)] + LONG
    docs = documents(spark, rows)
    _, found = removed(spark, rows)
    assert found == brute.repeats(rows)
    marks = [(i, brute.simhash(t)) for i, t in rows]
    groups = brute.near_groups(marks)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint % 2**64, r.component_id) for r in got} == {i: (m, groups[i]) for i, m in marks}
    placed = {r.doc_id: r["size"] for r in hilbert.hilbert_shards(docs, shards=3).collect()}
    assert placed == {i: len((t or "").encode()) + 16 for i, t in rows}
    item = "seventeen green parrots were counted near the old harbour before the storm came in"
    assert held([item], [f"{t} {item} {t}" for _, t in LONG]) == [[(0, "verbatim")]] * len(LONG)
    scores = [r.quality_score for r in quality.with_quality(docs, quality.LineField(weights=np.random.default_rng(1).normal(size=3 * quality.N_OWN), slope=3.0)).collect()]
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores)


def test_walls_of_many_texts_are_exact(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "WALL_VALUES", 300)
    df = spark.range(3000).select(F.lpad((F.col("id") * 7 % 3000).cast("string"), 6, "0").alias("v"))
    assert hilbert.text_walls(df, F.col("v"), 14) == [f"{200 * (i + 1) - 1:06d}" for i in range(14)]
