"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import base64
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import bpe, chat, html, html_pages, media, mixing, simhash, similar, token_counts, topk, toxicity, training_order
from tidemark.llm.common import fresh_dir
from tidemark.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [None, "", "one", "one", " \t\n ", "Two Words", "a b c d", "A  b\nc D", "a b c d e f g h", LONG, LONG + " end", "ß ä 漢字 😀 é", "x" * 5000, "a b c d e f g h", "nul\x00 and \x1c \x85 \u3000 marks"]


def docs_of(spark, texts=TEXTS, more=()):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)] + list(more)
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """Repeated rows, null ids and sources, and columns whose names operators might use themselves."""
    again = [(3, "one", "en", "s0", 3), (3, "one", "en", "s0", 3), (None, "no id", None, None, None), (None, None, None, None, None)]
    df = docs_of(spark, more=again)
    for name in ("fp", "size", "FP", "root", "score", "place", "tm_row", "tm_size", "bucket", "start", "row", "ids"):
        if name.lower() not in [c.lower() for c in df.columns]:
            df = df.withColumn(name, F.lit(7))
    return df


def split_words(text):
    return (text or "").encode().split()


# 1


def brute_fingerprint(text):
    import xxhash

    words = [w.lower() for w in split_words(text)]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=4):
    fps, root = sorted(set(fps)), {}
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def test_fingerprint_is_the_contracts(spark):
    for t in TEXTS:
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)
    spark_hash = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] & (1 << 64) - 1
    assert simhash.fingerprint(b"A b\nC  d") == spark_hash
    assert simhash.fingerprint(b" ") == 0


@pytest.mark.parametrize("hot", [1, 3, 8192])
def test_near_duplicates_match_brute_force(spark, hot):
    r = random.Random(1)
    base = [" ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(60)) for _ in range(12)]
    texts = TEXTS + base + [b + " " + "z" * (i % 3) for i, b in enumerate(base)] + [b.replace("a", "q", 1) for b in base]
    docs = docs_of(spark, texts)
    fps = [brute_fingerprint(t) for t in texts]
    roots, first = brute_components(fps), {}
    for i, f in enumerate(fps):
        first.setdefault(roots[f], i)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, hot_block=hot).collect()}
    assert got == {i: (f"{f:016x}", first[roots[f]]) for i, f in enumerate(fps)}


@pytest.mark.parametrize("distance, pieces, hot", [(4, 6, 1), (4, 6, 1000), (3, 5, 1), (3, 5, 1000), (4, 8, 1000), (2, 4, 2)])
def test_links_connect_what_close_pairs_connect(spark, distance, pieces, hot):
    r = random.Random(distance * 100 + pieces)
    fps = [r.getrandbits(64) for _ in range(40)]
    for _ in range(200):
        fps.append(r.choice(fps) ^ sum({1 << r.randrange(64) for _ in range(r.randint(1, distance + 1))}))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = {r["fp"] & (1 << 64) - 1: r["root"] for r in simhash.classes(spark.createDataFrame(signed, "fp long"), distance, pieces, hot).collect()}
    want, groups = brute_components(fps, distance), defaultdict(set)
    for f, x in got.items():
        groups[x].add(f)
    brute = defaultdict(set)
    for f, x in want.items():
        brute[x].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_forest_spans_a_large_cluster():
    r = random.Random(5)
    fp = np.unique(np.array([r.getrandbits(64) for _ in range(30)] * 1 + [0xABCDEF ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(i)], np.uint64))
    u, v = simhash.links_of_sorted(np.zeros(len(fp), np.int64), fp, 4)
    assert len(u) < len(fp)
    assert (np.bitwise_count(u ^ v) <= 4).all()
    all_pairs = simhash.links_of_sorted(np.zeros(len(fp), np.int64), fp, 4, small=10_000)
    join = lambda a, b: len({frozenset(s) for s in _sets(fp, a, b)})
    assert join(u, v) == join(*all_pairs)


def _sets(fp, u, v):
    own = {int(f): {int(f)} for f in fp}
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        if own[a] is not own[b]:
            own[a] |= own[b]
            for x in own[b]:
                own[x] = own[a]
    return own.values()


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(0, 200)]
    hub = [(1000, 1001 + i) for i in range(300)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame([*path, *hub, (7, 7), (None, 3)], "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1301)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_odd_rows(spark):
    rows = simhash.near_duplicates(odd(spark)).collect()
    assert len(rows) == odd(spark).count()
    ones = {r["component_id"] for r in rows if r["fingerprint"] == f"{brute_fingerprint('one'):016x}"}
    assert ones == {2}
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    nameless = simhash.near_duplicates(spark.createDataFrame([(None, "alone here")], "doc_id long, text string")).collect()
    assert nameless[0]["component_id"] is None


def test_keep_one(spark):
    df = odd(spark)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = kept.collect()
    classes = {(r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert len(got) == len({c for _, c in classes})
    assert [r["doc_id"] for r in got if r["text"] == "one"] == [2]
    same = docs_of(spark, [], [(5, "only this", "en", "s", 9)] * 3)
    assert simhash.keep_one(same).count() == 1
    assert simhash.keep_one(docs_of(spark, [])).count() == 0


def brute_similar(texts):
    """Root of each text by five-word Jaccard of 0.8 or more, over all pairs."""
    sets = []
    for t in texts:
        words = [w.lower() for w in split_words(t)]
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if (not a and not sets[j]) or 5 * both >= 4 * len(a | sets[j]) > 0:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def test_near_duplicate_stage_takes_similarity_of_four_fifths(spark):
    r = random.Random(12)
    base = [["w%d" % r.randrange(5000) for _ in range(120)] for _ in range(6)]
    texts = TEXTS + [" ".join(b) for b in base]
    for b in base:
        for edits in (1, 2, 3, 4, 8):  # similarities from 0.92 down to under 0.6
            made = list(b)
            for at in range(edits):
                made[5 + at * 13] = "edit%d" % r.randrange(10**6)
            texts.append(" ".join(made))
    chain = list(base[0])
    for at in range(10, 110, 20):  # each near the one before, not near the first
        chain[at] = chain[at + 5] = "link%d" % at
        texts.append(" ".join(chain))
    docs = docs_of(spark, texts)
    roots = brute_similar(texts)
    got = corpus_pipeline.without_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(x["doc_id"] for x in got.collect()) == sorted(set(roots))
    assert len(set(roots)) < simhash.keep_one(docs).count()


def test_sketch_is_a_simhash_of_the_shingles():
    r = np.random.default_rng(15)
    for n in (1, 2, 9, 300, 5000):
        found = np.unique(r.integers(0, 1 << 64, n, np.uint64))
        drawn = found[:, None] ^ similar._DRAWN
        for m in similar._MIXED:
            drawn = drawn * m
            drawn = drawn ^ drawn >> np.uint64(32)
        ones = np.array([[(drawn[:, j] >> np.uint64(63 - b) & np.uint64(1)).sum() for b in range(64)] for j in range(similar.SKETCH_WORDS)]).ravel()
        assert np.unpackbits(np.frombuffer(similar.sketch(found), np.uint8)).tolist() == (2 * ones > len(found)).astype(int).tolist()
    assert similar.sketch(found[:0]) is None


@pytest.mark.parametrize("part", [30, 1 << 18])
def test_candidates_are_close_texts_of_simhash_blocks(spark, monkeypatch, part):
    monkeypatch.setattr(similar, "PART", part)
    r = random.Random(16)
    words = [[b"%d" % r.randrange(999) for _ in range(80)] for _ in range(30)]
    texts = [b" ".join(w[:k] + [b"y%d" % i] * (80 - k)) for i, w in enumerate(words) for k in (80, 75, 68, 40)]
    bits = [np.unpackbits(np.frombuffer(similar.sketch(s), np.uint8)) for s in similar.shingle_sets(pa.array(texts, pa.binary()))[1]]
    got = {(x["fp"], x["hub"]) for x in similar._members(spark.createDataFrame([(i, bytearray(np.packbits(b).tobytes())) for i, b in enumerate(bits)], "fp long, sketch binary")).collect()}
    want, tables = set(), similar.tables_of(similar.KEY_BITS)
    for t in tables:
        for i in range(len(texts)):
            reached = [i]
            for j in reached:
                reached += [k for k in range(len(texts)) if k not in reached and (bits[j][t] == bits[k][t]).all() and (bits[j] != bits[k])[: 64 * similar.SCREEN_WORDS].sum() <= similar.SCREEN_BITS]
            if min(reached) != i:
                want.add((i, min(reached)))
    assert got == want and len(want) >= 60


@pytest.mark.parametrize("small", [1, 100])
def test_clusters_of_small_and_large_blocks_are_the_same(small):
    r = np.random.default_rng(17)
    entries = np.zeros(300, similar._ENTRY)
    entries["key"], entries["fp"] = np.sort(r.integers(0, 8, 300)), np.arange(300)
    near = r.integers(0, 1 << 64, (20, similar.SCREEN_WORDS), np.uint64)[r.integers(0, 20, 300)]
    for i in range(similar.SCREEN_WORDS):
        entries[f"w{i}"] = near[:, i] ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64))
    places, least = similar.clusters(entries, small)
    same = [[j for j in range(300) if entries["key"][j] == entries["key"][i] and (near[j] == near[i]).all()] for i in range(300)]
    assert dict(zip(places.tolist(), least.tolist(), strict=True)) == {i: min(x) for i, x in enumerate(same) if len(x) > 1}


def test_group_of_near_copies_is_searched_once(spark, monkeypatch):
    r = random.Random(18)
    base, seen, search = [b"%d" % r.randrange(9999) for _ in range(300)], [], similar._searched
    texts = []
    for i in range(60):
        made = list(base)
        for at in r.sample(range(0, 295, 6), 7):
            made[at] = b"e%d.%d" % (i, at)
        texts.append(b" ".join(made))
    monkeypatch.setattr(similar, "_searched", lambda rows: seen.append(sorted(x["fp"] for x in rows.select("fp").collect())) or search(rows))
    kept = similar.keep_one(docs_of(spark, [t.decode() for t in texts]))
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(brute_similar([t.decode() for t in texts])))
    assert seen and len(seen[0]) == len(set(seen[0]))


@pytest.mark.parametrize("tile", [100, 1 << 20])
def test_blocks_are_searched_in_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(similar, "TILE_HASHES", tile)
    r = random.Random(14)
    words = [[b"%d" % r.randrange(999) for _ in range(60)] for _ in range(6)]
    texts = [b" ".join(w[:k] + [b"x%d" % i] * (60 - k)) for i, w in enumerate(words * 2) for k in (60, 58, 57, 30)]
    sets = similar.shingle_sets(pa.array(texts, pa.binary()))[1]
    rows = [(b, i, i, sets[i].view(np.int64).tolist()) for b in (1, 2) for i in range(len(texts)) if b == 1 or i % 4 < 2] + [(3, 0, 0, [7])]
    found = {tuple(x) for x in similar._searched(spark.createDataFrame(rows, "block long, fp long, root long, hashes array<bigint>")).collect()}
    parts = {x["b"] for x in similar._tiles(spark.createDataFrame(rows, "block long, fp long, root long, hashes array<bigint>")).collect()}
    assert (len(parts) > 2) == (tile == 100)
    root = list(range(len(texts)))
    for a, b in found:
        assert len(np.intersect1d(sets[a], sets[b])) * 5 >= 4 * len(np.union1d(sets[a], sets[b]))
        root = [root[b] if x == root[a] else x for x in root]
    roots = brute_similar([t.decode() for t in texts])
    assert len({*zip(root, roots, strict=True)}) == len(set(root)) == len(set(roots))


def near_texts(r, groups, n, edits):
    """Groups of n texts of 400 words with some of them edited, most of them near copies of each other's or, with many edits, few."""
    texts = []
    for g in range(groups):
        base = ["w%d" % r.randrange(9999) for _ in range(400)]
        for i in range(n):
            made = list(base)
            for at in r.sample(range(0, 395, 6), edits):
                made[at] = "e%d.%d.%d" % (g, i, at)
            texts.append(" ".join(made))
    return texts


def test_shingles_of_near_copies_are_sent_a_few_times(spark):
    docs = docs_of(spark, texts := near_texts(random.Random(19), 1, 300, 9)).localCheckpoint()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    before, most = written(), spark.conf.get(key := "spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        assert similar.keep_one(docs).count() == len(set(brute_similar(texts)))
    finally:
        spark.conf.set(key, most)
    # twice about, not once for each text that one is held against in some table
    assert 0 < written() - before < 4 * 8 * 396 * len(texts)


@pytest.mark.parametrize("edits", [3, 9])
def test_groups_of_many_parts_have_the_same_classes(spark, monkeypatch, edits):
    texts = near_texts(random.Random(20), 3, 20, edits)
    seen, large = [], similar._large_classes
    monkeypatch.setattr(similar, "TILE_HASHES", 2000)
    monkeypatch.setattr(similar, "_large_classes", lambda rows: seen.append(rows.count()) or large(rows))
    kept = similar.keep_one(docs_of(spark, [*texts, "some other text", *TEXTS]))
    roots = brute_similar([*texts, "some other text", *TEXTS])
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(roots))
    assert seen == [60]


def test_classes_of_small_groups_are_named_by_their_task(spark):
    links = [(b * 100 + i + 1, b * 100 + i) for b in range(1, 9) for i in range(b)]
    frame = spark.createDataFrame(random.Random(21).sample(links, len(links)), "u long, v long").coalesce(1)
    assert {tuple(x) for x in similar._named(frame).collect()} == {(b * 100 + i, b * 100) for b in range(1, 9) for i in range(1, b + 1)}
    assert similar._named(spark.createDataFrame([], "u long, v long")).count() == 0


def test_block_is_searched_for_every_verified_pair():
    r = random.Random(13)
    words = [[b"%d" % r.randrange(999) for _ in range(60)] for _ in range(8)]
    texts = [b" ".join(w[:k] + [b"x%d" % i] * (60 - k)) for i, w in enumerate(words * 4) for k in (60, 58, 57, 30)]
    roots = brute_similar([t.decode() for t in texts])
    sets = similar.shingle_sets(pa.array([t or b"" for t in texts], pa.binary()))[1]
    for known in (np.arange(len(texts)), np.array([0 if x == roots[0] else 1000 + i for i, x in enumerate(roots)])):
        now = known.tolist()
        for a, b in similar.links_of_block(known, sets):
            assert len(np.intersect1d(sets[a], sets[b])) * 5 >= 4 * len(np.union1d(sets[a], sets[b]))
            now = [now[b] if x == now[a] else x for x in now]
        assert len({*zip(now, roots, strict=True)}) == len(set(now)) == len(set(roots))


# 2


def block_f1(pages, field):
    hit = over = under = 0
    for page, marks in pages:
        y = html.labelled(page, marks)[1]
        got = field.viterbi(field.scores(html.leaf_blocks(page), {}))
        hit += sum(a and b for a, b in zip(got, y, strict=True))
        over += sum(a and not b for a, b in zip(got, y, strict=True))
        under += sum(b and not a for a, b in zip(got, y, strict=True))
    return 2 * hit / (2 * hit + over + under)


def test_extraction_on_pages_and_names_not_trained_on():
    assert block_f1(html_pages.labelled_pages(100, seed=99), html.default_field()) > 0.98
    assert block_f1(html_pages.bare_pages(100, seed=98), html.default_field()) > 0.97

    class Foreign(html_pages._Bare):
        def __init__(self, seed):
            super().__init__(seed)
            self.style = "foreign"

    without = html.train([html.labelled(*p) for p in (*html_pages.labelled_pages(300), *html_pages.bare_pages(300, foreign=False))])
    assert block_f1([Foreign(777_000 + i).page() for i in range(100)], without) > 0.95


P1 = "The river rises in the hills above the town and runs south for forty miles, past mills and meadows, to the sea."
P2 = "It was first mapped in 1815, when surveyors walked its whole length in a wet summer; their notes are kept in the county archive."
P3 = "Since then its course has changed twice. Floods in 1901 moved the lower bend, and a lock was built soon after."
#: Pages by hand, in layouts that no generator makes: html and the article's blocks.
BY_HAND = {
    "nameless": (f"<body><div><div>Daily Post</div><div><a href=/>Home</a> <a href=/w>World</a> <a href=/s>Sport</a></div></div><div><h1>River moves</h1><div>{P1}</div><div>{P2}</div><div>{P3}</div></div><div><div>Most read</div><div><a href=/1>Cat wins prize</a></div><div><a href=/2>Rain expected</a></div></div><div>© 2024 Daily Post. All rights reserved.</div>", ["River moves", P1, P2, P3]),
    "encyclopaedia": (f'<body><div id="mw-navigation"><ul><li><a href=/>Main page</a></li><li><a href=/r>Random</a></li></ul></div><div id="content"><h1 id="firstHeading">River</h1><div id="bodyContent"><table class="infobox"><tr><th>Length</th><td>40 miles</td></tr></table><p>{P1}</p><p>{P2}</p><h2>Course</h2><p>{P3}</p></div></div><div id="footer"><ul><li><a href=/p>Privacy policy</a></li><li><a href=/a>About</a></li></ul></div>', ["River", "Length", "40 miles", P1, P2, "Course", P3]),
    "german": (f'<body><div class="kopfzeile">Tageblatt</div><div class="hauptmenue"><a href=/>Start</a> | <a href=/p>Politik</a></div><div class="inhalt"><h1>Der Fluss</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div><div class="seitenleiste"><h3>Meistgelesen</h3><ul><li><a href=/1>Katze</a></li><li><a href=/2>Regen</a></li></ul></div><div class="fusszeile">Impressum</div>', ["Der Fluss", P1, P2, P3]),
    "blog": (f'<body><div class="wrap"><div class="hd"><h1><a href=/>My walks</a></h1></div><div class="pst"><h2>Along the river</h2><p>{P1}</p><blockquote>{P2}</blockquote><p>{P3}</p></div><div class="rsp"><h3>2 responses</h3><div><div>Ann</div><p>Lovely photos!</p></div><div><div>Bob</div><p>I went there last year. Great place.</p></div></div><div class="sb"><h4>Archive</h4><ul><li><a href=/1>April</a></li><li><a href=/2>March</a></li></ul></div></div>', ["Along the river", P1, P2, P3]),
    "formula": (f"<body><article><h1>Sum</h1><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds, wor<script>1</script>d. {P1}</p><object><p>{P2}</p></object></article>", ["Sum", f"So x=1 holds, word. {P1}", P2]),
    "open drawing": (f'<body><article><p><svg><title>icon</title><path d="M0"><p>{P1}</p><p>{P2}</p></article>', [P1, P2]),
    "stray quotes": (f"<body><article><h1 title=it's>Fine</h1><p data-x=5\">{P1}</p><p title='a > b'>{P2}</p></article>", ["Fine", P1, P2]),
    "old main": (f"<body><main><h1>Old</h1><p>{P1}<p>{P2}<h2>More</h2><p>{P3}</main><footer><p>© Somebody</p></footer>", ["Old", P1, P2, "More", P3]),
}


@pytest.mark.parametrize("name", BY_HAND)
def test_extraction_of_pages_by_hand(name):
    page, want = BY_HAND[name]
    assert html.main_text(page, html.default_field()).split("\n") == want


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "x", "<b>" + "<div>" * 20_000 + "</b>" * 60_000, "<a " * 100_000, "<a \">\" " * 60_000, "<a title=\"" * 50_000 + ">", "<" * 300_000, "".join(f'<div class="c{i}x">' for i in range(30_000)) + "t", "<li>" * 100_000, "<!--" * 100_000, "<script>" * 50_000])
def test_broken_pages_take_time_in_proportion(page):
    began = time.perf_counter()
    html.main_text(page, html.default_field())
    assert time.perf_counter() - began < 5


def test_viterbi_is_the_best_labelling():
    from itertools import product

    r = np.random.default_rng(1)
    f = html.Field({}, r.normal(size=(2, 2)), r.normal(size=2))
    for n in range(1, 7):
        u = r.normal(size=n)
        score = lambda y: f.first[y[0]] + sum(u[i] for i in range(n) if y[i]) + sum(f.step[y[i], y[i + 1]] for i in range(n - 1))  # noqa: E731, B023
        assert np.isclose(score(f.viterbi(u.tolist())), max(score(y) for y in product((0, 1), repeat=n)))
        p, pairs, first = html._marginals(np.pad(u, (0, 3))[None], np.array([n]), f.step, f.first)
        z = sum(np.exp(score(y)) for y in product((0, 1), repeat=n))
        want = [sum(np.exp(score(y)) for y in product((0, 1), repeat=n) if y[i]) / z for i in range(n)]
        assert np.allclose(p[0], [*want, 0, 0, 0]) and np.isclose(pairs.sum(), n - 1) and np.isclose(first.sum(), 1)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:"</p>"}</style><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><!-- x > y --><div class="cookie-banner">We use cookies.</div>
<article><h1>Fish &amp; chips&#33;</h1><p>First   <b>bold</b>
line<br>goes on.<p>Second &lt;one&gt; a&nbsp;b.<div class="ad">Buy now, it is cheap.</div><form><p>Your mail</p><input></form>
<aside class="sidebar"><p>Related things.</p></aside><blockquote>Quoted words.</blockquote><section class="comments"><h3>Comments</h3><p>I like this a lot.</p></section></article>
<footer>&copy; 2020 Someone</footer></body></html>"""


def test_extraction_of_one_page():
    assert html.main_text(PAGE, html.default_field()) == "Fish & chips!\nFirst bold line goes on.\nSecond <one> a b.\nQuoted words."


def test_head_without_its_end_tag():
    whole = [(html.context(b.node), b.text, b.linked) for b in html.leaf_blocks(PAGE)]
    assert "</head>" in PAGE.lower() and whole
    bare = PAGE.replace("</head>", "")
    assert [(html.context(b.node), b.text, b.linked) for b in html.leaf_blocks(bare)] == whole
    assert html.main_text(bare, html.default_field()) == html.main_text(PAGE, html.default_field())
    start = "<html><head><title>Of <b>no</b> use</title><meta charset=utf-8><script>x</script>"
    for body in ("<p>Seen.</p>", "<div><p>Seen.", "Seen.", "<a href=x>Seen.</a>", "<img src=x>Seen.", "<body class=a>Seen.", "</head>Seen."):
        assert [b.text for b in html.leaf_blocks(start + body)] == ["Seen."], body
    assert [b.text for b in html.leaf_blocks("<head><title>Never ended<body><p>Seen.")] == ["Seen."]


def test_extraction_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "u", ""), (3, "u", "<p"), (4, "u", "<a title='x>" * 50), (5, "u", "<article>" + "<p>long text here.</p>" * 3000)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html.extract(pages).collect()
    assert len(got) == 7 and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[2] == "" and by[None] == "" and by[5] == "\n".join(["long text here."] * 3000)
    assert html.extract(pages.limit(0)).count() == 0


# 3


def test_media_matches_brute_force(spark):
    for r in media.features(odd(spark).withColumn("media", F.lit(1))).collect():
        if r["doc_id"] is None:
            continue
        data = (TEXTS[r["doc_id"]] or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert media.features(docs_of(spark, [])).count() == 0


def test_equal_texts_have_equal_media(spark):
    same = defaultdict(set)
    for r in media.features(docs_of(spark).repartition(5)).collect():
        same[r["payload_sha256"]].add((r["feature"], r["media_sha256"], r["media_bytes"]))
    assert all(len(v) == 1 for v in same.values())


def test_wav_is_read_by_others_and_back(tmp_path):
    import wave

    payload = media.pad(bytes(range(256)) * 3)
    (tmp_path / "x.wav").write_bytes(media.to_wav(payload))
    with wave.open(str(tmp_path / "x.wav")) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, media.STORED_RATE)
        assert w.readframes(10**6) == payload
    assert media.from_wav(media.to_wav(payload)) == (payload, media.STORED_RATE)
    with pytest.raises(ValueError):
        media.from_wav(b"no wav")


def test_resampling_keeps_a_tone_and_drops_what_would_alias():
    t = np.arange(16_000) / media.STORED_RATE
    for hz, low, high in ((500, 0.9, 1.1), (7_500, 0.0, 0.1)):
        y = media.resample(np.sin(2 * np.pi * hz * t))
        assert len(y) == 10_000
        assert low <= np.abs(y[200:-200]).max() <= high
    mels, _ = media.log_mels(media.resample(np.sin(2 * np.pi * 500 * t)))
    assert len({int(f.argmax()) for f in mels[5:-5]}) == 1


def test_resampling_matches_the_plain_filter():
    x = np.random.default_rng(0).normal(size=333)
    h, up, down, taps = media._phases(media.UP, media.DOWN, media.TAPS), media.UP, media.DOWN, media.TAPS
    padded = np.concatenate((np.zeros(taps - 1), x))
    want = [h[m * down % up] @ padded[m * down // up : m * down // up + taps] for m in range(-(-len(x) * up // down))]
    assert np.allclose(media.resample(x), want)


def test_segments_have_hysteresis():
    e = np.array([0, 0, 0, 0.5, 2, 0.5, 0.5, 0, 0.5, 0.5, 0.5, 0, 2, 0, 0, 0, 0.0])
    assert media.segments(e, rise=1.5, fall=0.25, least=3) == [(3, 7)]


def test_clips_are_fixed_shape_tensors_with_spans(spark):
    row = media.media(docs_of(spark, [LONG])).first()
    clips = media.from_ipc(bytes(row["clips"]))
    assert clips.schema.field("tensor").type == media.tensor_type()
    spans = list(zip(clips["start_s"].to_pylist(), clips["end_s"].to_pylist(), strict=True))
    assert all(a < b for a, b in spans) and spans[0][0] == 0 and abs(spans[-1][1] - len(LONG) / media.STORED_RATE) < 0.05


# 4


def brute_top(rows, k=10):
    ok = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("tile", [4096, 7])
def test_top_k_matches_brute_force(spark, monkeypatch, tile):
    r = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in (r.integers(-2, 3, 8) if i % 3 else r.normal(size=8))]) for i in range(400)]
    rows += [(500, None), (600, [None] + [1.0] * 7), (501, [float("nan")] * 8), (700, [float("inf")] * 8), (None, [1.0] * 8), (800, []), (801, []), (900, [1.0]), (901, [2.0]), (1000, [5.0, 1.0, 2.0])]
    monkeypatch.setattr(topk, "TILE_ROWS", tile)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    got = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.search(df, F.col("vec_id") % 100 == 0).collect())
    assert got == brute_top(rows)
    assert topk.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_with_numbers_beyond_float_exactness(spark):
    rows = [(0, [1e6, 1.0]), (1, [1e6 + 1, 1.0]), (2, [1e6, 2.0]), (3, [-1e6, 5.0]), (4, [1.5e6, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.search(df, F.col("vec_id") % 100 == 0).collect())
    assert got == brute_top(rows)


# 5


def test_grammar_scores_clauses():
    lex = toxicity.Lexicon({})
    say = lambda *texts: toxicity.describe(pa.array([t.encode() for t in texts], pa.large_binary()), lex)
    plain, aimed, negated, reported, later, idle, threat, burn = say("what an idiot", "you are an idiot", "you are not an idiot", "he said idiot", "idiots you are", "you must kill the process", "i will kill you", "you will burn")[:, :4]
    assert plain[toxicity.PLAIN] > 0 and aimed[toxicity.AIMED] > 0 and negated[toxicity.NEGATED] > 0 and reported[toxicity.REPORTED] > 0
    assert later[toxicity.AIMED] > 0 and threat[toxicity.AIMED] > 0 and burn[toxicity.AIMED] > 0
    assert idle[toxicity.AIMED] == 0 and idle[toxicity.PLAIN] < threat[toxicity.AIMED]
    assert say("you . idiot")[0, toxicity.AIMED] == 0  # another clause
    assert say().shape == (0, toxicity.N_FEATURES) and say("").shape == (1, toxicity.N_FEATURES)
    neutral = toxicity.Model({}, toxicity.PRIOR, np.zeros(toxicity.N_FEATURES), np.ones(toxicity.N_FEATURES), -4.0)
    kill, process, idiot, word = neutral.scores(say("I will kill you", "you must kill the process", "you are an idiot", "the word idiot"))
    assert kill > 3 * process and idiot > 3 * word


def test_composed_machine_is_the_transducers_one_after_the_other():
    for n in range(1, 6):
        for clause in itertools.product(toxicity.CLASSES, repeat=n):
            if not any(c in toxicity.ATTACKS for c in clause):
                continue
            symbols, state = [None] * n, toxicity.LOOKAHEAD.start
            for i in reversed(range(n)):
                state, symbols[i], _ = toxicity.LOOKAHEAD.step(state, (clause[i],))
            factors = [1.0] * n
            for part in toxicity.PARTS:
                state = part.start
                for i in range(n):
                    state, symbols[i], f = part.step(state, symbols[i])
                    factors[i] *= f
            want = [(toxicity.channel_of(x), f) for x, f in zip(symbols, factors, strict=True) if x[0] in toxicity.ATTACKS]
            assert toxicity.walk(list(clause)) == want


def brute_describe(text, weights):
    """describe() of one text, word by word and without the composed machine or any batch."""
    sums, strongest, hits, clauses, attacked, n = [0.0] * 4, 0.0, set(), 1, 0, 0
    clause: list[tuple[int, float, str]] = []

    def close():
        nonlocal strongest, attacked
        got = toxicity.walk([c for c, _, _ in clause])
        for (channel, factor), (_, w, word) in zip(got, [x for x in clause if x[0] in toxicity.ATTACKS], strict=True):
            sums[channel] += w * factor
            strongest = max(strongest, w * factor)
            hits.add(word)
        attacked += bool(got)
        clause.clear()

    for token in re.findall(r"[^\W\d_]+|[.!?;:,\n\"“”«»()|]", text.lower()):
        n += 1
        if not token[0].isalpha():
            close()
            clauses += 1
            continue
        w = max((weights.get(f, 0.0) for f in toxicity.features_of(token)), default=0.0)
        kind = next((k for k, words in ((toxicity.INSULT, toxicity.INSULTS), (toxicity.THREAT, toxicity.THREATS), (toxicity.NEGATION, toxicity.NEGATIONS), (toxicity.REPORT, toxicity.REPORTS), (toxicity.TARGET, toxicity.TARGETS)) if token in words), toxicity.OTHER)
        if w > 0 and kind == toxicity.OTHER:
            kind = toxicity.INSULT
        clause.append((kind, max(w, {toxicity.INSULT: toxicity.SEED_INSULT, toxicity.THREAT: toxicity.SEED_THREAT}.get(kind, 0.0)) if token in toxicity.INSULTS | toxicity.THREATS else w, token))
    close()
    total = sum(sums)
    return [*map(math.log1p, sums), strongest / 4, math.log1p(len(hits)), total / math.sqrt(n + 20), 10 * attacked / (clauses + 10), math.log1p(n) / 4]


def test_batches_are_described_as_single_texts():
    r = random.Random(55)
    weights = {"grub": 3.0, "zor*": 2.5, "wexling*": 4.0, "you": 1.0}
    words = ["idiot", "kill", "you", "not", "said", "grub", "grubs", "zorfist", "zor", "wexlings", "été", "Ünder", "the", "a1b", "x_y", "they", "\0", "nul\0l", "IDIOT", "don't"]
    ends = [" ", " ", " ", ", ", ". ", "\n", "  ", "\t", "\u00a0", "\u3000", "!"]
    texts = ["".join(r.choice(words) + r.choice(ends) for _ in range(r.randint(0, 40))) for _ in range(400)] + ["", " ", "idiot", "kill " * 3000]
    lex = toxicity.Lexicon(weights)
    for _ in range(2):
        got = toxicity.describe(pa.array([t.encode() for t in texts], pa.large_binary()), lex)
        assert np.allclose(got, [brute_describe(t, weights) for t in texts])
        lex.most = 1  # the second time nothing is kept from before


def test_learned_words_and_held_out_accuracy(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 6)))
    bad = ["grubnak", "zorfist", "wexling"]
    rows, labels = [], []
    for i in range(900):
        words, y = [word() for _ in range(r.randint(5, 60))], int(i % 5 == 0)
        for _ in range(r.randint(2, 5) * y):
            words.insert(r.randrange(len(words)), r.choice(bad) + r.choice(["", "en", "s"]))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, y))
    labels += [(None, 1, 1), (5000, 1, None), (6000, 0, 1)]
    docs, labelled = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score(docs, labelled).collect()}
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, x in got.items())
    held = [(x["predicted"], int(i % 5 == 0)) for i, x in got.items() if x["held_out"]]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    clean = toxicity.reject(docs, labelled)
    assert clean.columns == docs.columns and {x["doc_id"] for x in clean.collect()} == {i for i, x in got.items() if not x["predicted"]}


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score(odd(spark), labels).collect()
    assert len(rows) == odd(spark).count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    assert toxicity.score(docs_of(spark, []), labels).count() == 0
    assert toxicity.reject(odd(spark), labels).columns == odd(spark).columns


# 6


def test_targets():
    assert mixing.targets([100, 100, 100]) == [50, 100, 150]
    assert mixing.targets([1, 1000]) == [3, 998]
    assert mixing.targets([10, 0, 10]) == [Fraction(5), 0, Fraction(15)]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


def test_splitting_tree_keeps_quotas():
    q = np.array([1000, 0, 17, 5])
    dealt = mixing.splitting_tree(q, 13)
    assert (dealt.sum(axis=1) == q).all() and (dealt >= 0).all()
    assert np.ptp(dealt.sum(axis=0)) <= 2
    assert (mixing.splitting_tree(q, 13) == dealt).all()


def check_mix(rows, docs):
    sizes, sources = {}, defaultdict(int)
    for d in docs:
        sources[d["source"]] += len(split_words(d["text"]))
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([sources[s] for s in order]), strict=True))
    assert sum(sources.values()) == round(sum(want.values()))
    taken = defaultdict(int)
    assert len(rows) == len(docs)
    by_id = defaultdict(list)
    for d in docs:
        by_id[d["doc_id"]].append(d)
    for r in rows:
        if r["doc_id"] is None:
            continue
        d = by_id[r["doc_id"]][0]
        assert r["size"] == len(split_words(d["text"])) and r["taken"] <= 3 * r["size"]
        assert r["source_size"] == sources[d["source"]] and abs(r["target"] - float(want[d["source"]])) < 1e-6
    for t in {(r["source_size"], r["target"]) for r in rows}:
        got = sum(r["taken"] for r in rows if (r["source_size"], r["target"]) == t)
        n = sum(1 for s in order if (sources[s], float(want[s])) == t) or 1
        assert abs(got - n * t[1]) <= n


def test_mix(spark):
    r = random.Random(6)
    docs = docs_of(spark, [" ".join(["w"] * r.randrange(80)) for _ in range(300)], [(1000, "a b c", "en", None, 5), (1001, None, "en", "s9", 0)])
    rows = mixing.mix(docs, block_words=16).collect()
    check_mix(rows, docs.collect())
    again = mixing.mix(docs.repartition(7), block_words=16).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    taken = lambda **how: {x["doc_id"]: x["taken"] for x in mixing.mix(docs, block_words=16, **how).collect()}
    other = taken(seed=5)
    assert other != taken() and sum(other.values()) == sum(taken().values())


def test_deal_of_very_many_draws():
    q = np.array([10_000, 0, 3_333, 7])
    dealt = mixing.deal(q, 8, most=500)
    assert (dealt.sum(axis=1) == q).all() and (dealt >= 0).all() and np.ptp(dealt.sum(axis=0)) <= 2 * 27


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permuted(n):
    for key in (1, 2**63 + 5):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
        assert sorted(got.tolist()) == list(range(n))
    assert n < 7 or (got != np.arange(n)).any()


@pytest.mark.parametrize("size, quota, block", [(100, 0, 10), (100, 100, 10), (103, 57, 10), (103, 250, 10), (7, 5, 10), (7, 21, 10), (40, 39, 10), (1000, 333, 1)])
def test_draws_are_disjoint_and_meet_the_quota(size, quota, block):
    cut = sorted(random.Random(size).sample(range(size + 1), min(size, 6)))
    start = np.array([0, *cut], np.int64)
    n = np.diff(np.append(start, size))
    row, number, blocks, first, words = mixing.draw(block, 9, np.zeros(len(n), np.int64), np.full(len(n), size), np.full(len(n), quota), start, n)
    assert words.sum() == quota and (words > 0).all() and set(number.tolist()) <= set(range(mixing.draws_of(size, quota, block)))
    seen = Counter()
    for r, d, b, f, w in zip(row.tolist(), number.tolist(), blocks.tolist(), first.tolist(), words.tolist(), strict=True):
        assert (start[r] + f) // block == (start[r] + f + w - 1) // block == b
        seen.update((d, int(start[r]) + f + i) for i in range(w))
    assert set(seen.values()) <= {1}
    times = Counter(w for _, w in seen)
    assert not times or max(times.values()) - min(times.get(w, 0) for w in range(size)) <= 1


def test_mix_odd_rows(spark):
    check_mix(mixing.mix(odd(spark)).collect(), odd(spark).collect())
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert {r["taken"] for r in mixing.mix(docs_of(spark, [None, "", " "])).collect()} == {0}


def test_spans_are_disjoint_and_whole(spark):
    docs = docs_of(spark, [" ".join(["w"] * (i % 40)) for i in range(200)])
    rows = mixing.spans(docs, shards=8, block_words=32).collect()
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, shards=8, block_words=32).collect()}
    seen, blocks = Counter(), {}
    for r in rows:
        for w in range(r["first_word"], r["first_word"] + r["words"]):
            seen[r["doc_id"], r["draw"], w] += 1
        assert blocks.setdefault((r["source_no"], r["draw"]), (r["shard"], r["block"])) == (r["shard"], r["block"])
    assert set(seen.values()) == {1}
    assert Counter(k[0] for k in seen) == Counter({k: v for k, v in taken.items() if v})
    held = defaultdict(set)
    for r in rows:
        held[r["doc_id"]].add(r["shard"])
    shards = {r["doc_id"]: r["shards"] for r in mixing.mix(docs, shards=8, block_words=32).collect()}
    assert {k: ",".join(map(str, sorted(v))) for k, v in held.items()} == {k: v for k, v in shards.items() if v}


def test_applied_mix_is_near_its_targets(spark):
    r = random.Random(8)
    docs = docs_of(spark, [" ".join("w%d" % r.randrange(9) for _ in range(r.randrange(1, 60))) for _ in range(600)])
    whole = {x["doc_id"]: x for x in docs.collect()}
    rows = mixing.apply(docs, block_words=64)
    assert rows.columns == docs.columns
    got, sizes, sources = Counter(), Counter(), {x["source"] for x in whole.values()}
    for x in rows.collect():
        assert x == whole[x["doc_id"]]
        got[x["source"]] += len(split_words(x["text"]))
    for x in whole.values():
        sizes[x["source"]] += len(split_words(x["text"]))
    order = sorted(sources)
    for s, target in zip(order, mixing.targets([sizes[s] for s in order]), strict=True):
        assert abs(got[s] - target) <= 0.15 * target
    assert sorted(map(str, rows.collect())) == sorted(map(str, mixing.apply(docs.repartition(5), block_words=64).collect()))
    assert mixing.apply(odd(spark)).columns == odd(spark).columns
    assert mixing.apply(docs_of(spark, [])).count() == 0
    same = [(1, "a b c", "en", "x", 5)] * 30 + [(2, "d e f g", "en", "y", 7)]
    assert set(mixing.apply(docs_of(spark, [], same)).collect()) <= set(docs_of(spark, [], same).collect())
    assert abs(mixing.apply(docs_of(spark, [], same * 20)).where("doc_id = 1").count() - 20 * 82 / 3) < 30


def test_mixing_stage_keeps_texts_whole(spark):
    r = random.Random(9)
    texts = ["\n".join(" ".join("w%d" % r.randrange(9) for _ in range(r.randrange(1, 30))) for _ in range(3)) for _ in range(60)] + [LONG]
    docs = docs_of(spark, texts, [(1000 + i, " ".join(["few"] * (i + 1)), "en", f"small{i}", 4 * i + 3) for i in range(12)])
    whole = {x["doc_id"]: x for x in docs.collect()}
    got = defaultdict(list)
    for x in corpus_pipeline.mixed(spark, docs, "").collect():
        assert x == whole[x["doc_id"]]
        got[x["source"]].append(x["doc_id"])
    sizes = {k: len(split_words(x["text"])) for k, x in whole.items()}
    order = sorted({x["source"] for x in whole.values()})
    of = {s: [k for k, x in whole.items() if x["source"] == s] for s in order}
    for s, target in zip(order, mixing.targets([sum(sizes[k] for k in of[s]) for s in order]), strict=True):
        assert abs(sum(sizes[k] for k in got[s]) - target) <= max(sizes[k] for k in of[s])


# 7, 8


def test_token_counts(spark):
    df = odd(spark).withColumn("ordinal", F.lit(1))
    want = Counter((r["doc_id"], r["n_tokens"]) for r in bpe.round_trip(df).collect())
    for block in (1 << 20, 64, 6):
        assert Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.count(df, block_bytes=block).collect()) == want
    assert token_counts.count(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("block", [2, 4, 6, 10, 1000])
def test_scan_of_any_file(spark, tmp_path, block):
    r = random.Random(block)
    files, want = [], set()
    for n in range(6):
        ids = [r.choice([1, 2, 3, 9, 9]) for _ in range(r.randrange(40))] if n else []
        (tmp_path / f"{n}.bin").write_bytes(np.array(ids, "<u2").tobytes())
        files.append((f"{n}.bin", 2 * len(ids)))
        parts, own = [], 0
        for x in ids:
            if x == 9:
                parts.append(own)
                own = 0
            else:
                own += 1
        want |= {(f"{n}.bin", i, k) for i, k in enumerate(parts + [own] * (own > 0))}
    got = token_counts.scan_files(spark.createDataFrame(files, "file string, bytes long"), str(tmp_path), end=9, block_bytes=block)
    assert {(x["file"], x["ordinal"], x["n_tokens"]) for x in got.collect()} == want


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_feistel_permutes(n):
    p = training_order.Feistel(n)
    slots = p.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (p.sequence(slots) == np.arange(n)).all()
    if n == 1000:
        assert (training_order.Feistel(n, key=1).slot(np.arange(n)) != slots).any()


@pytest.mark.parametrize("length, shards", [(2048, 256), (64, 7), (100, 1)])
def test_training_order_round_trip(spark, tmp_path, monkeypatch, length, shards):
    monkeypatch.setattr(training_order, "LEAST_BYTES", 1000)
    odd(spark).select("text").write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    out = fresh_dir(spark, "test-order")
    plan = training_order.materialise(training_order.byte_streams(docs), out, length=length, shards=shards)
    permutation, got = plan.permutation(), {}
    for slot, ids in training_order.read_from(out, plan):
        got[int(permutation.sequence(np.array([slot]))[0])] = ids.tobytes()
    flat = b"".join(got[i] for i in range(plan.sequences))
    assert set(flat[plan.tokens :]) <= {training_order.END}
    assert sorted(flat[: plan.tokens - 1].split(b"\xff")) == sorted((r["text"] or "").encode() for r in docs.collect())
    half = plan.sequences // 2
    assert next(training_order.read_from(out, plan, half))[1].tobytes() == got[int(permutation.sequence(np.array([half]))[0])]
    rows = training_order.read_all(spark, out, plan).collect()
    assert sorted(r["slot"] for r in rows) == list(range(plan.sequences))
    assert all(r["sha256"] == hashlib.sha256(got[r["sequence"]][: r["n_tokens"]]).hexdigest() for r in rows)
    assert training_order.order(docs.limit(0)).count() == 0


def test_training_order_is_over_token_ids(spark, tmp_path):
    odd(spark).select("text").coalesce(1).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    stream = []
    for ids in bpe.tokenizer().encode_batch([x["text"] or "" for x in docs.collect()]):
        stream += [*ids, token_counts.END]
    flat = np.array(stream, "<u2")
    rows = training_order.order(docs).collect()
    assert sum(x["n_tokens"] for x in rows) == len(flat) and len(rows) == -(-len(flat) // 2048)
    for x in rows:
        part = flat[x["sequence"] * 2048 : (x["sequence"] + 1) * 2048]
        assert x["n_tokens"] == len(part) and x["sha256"] == hashlib.sha256(part.tobytes()).hexdigest()


# 9


def brute_chat(turns):
    by = defaultdict(list)
    for c, t, role, text in turns:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, rows in by.items():
        rows.sort()
        trained = "".join(x for *_, role, x in rows if role == "assistant")
        out[c] = (len(rows), sha("".join(f"{role}\n{x}\n" for *_, role, x in rows)), len(trained), sha(trained))
    return out


def test_chat_reads_back(spark):
    r = random.Random(9)
    bits = ["### ", "</turn>", "\\", "\\b", "\\t", "\\h", "#", "<", "/turn>", "Assistant: ", ": ", "\n", "😀", "é", "x", "$1", "\\Q", "\\E", "### user: "]
    turns = [(c, t, r.choice(["user", "assistant", "assistant", "system", "a: b", "### x", "</turn>", None]), None if r.random() < 0.05 else "".join(r.choice(bits) for _ in range(r.randrange(12)))) for c in range(60) for t in range(r.randrange(1, 9))]
    turns += [(1, 0, "user", "tie"), (1, 0, "user", "tie"), (2, None, "assistant", "early"), (None, 1, "assistant", "lost"), (500, 0, "assistant", LONG)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit(1)).withColumn("turns", F.lit(1))
    got = {x["conv_id"]: (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) for x in chat.digests(df).collect()}
    assert got == brute_chat(turns)
    assert chat.digests(df.limit(0)).count() == 0


def test_chat_merges_neighbours_and_stays_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c </turn>")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(df).first()
    assert row["formatted"] == "### user: a</turn>### assistant: b</turn>c \\t</turn>"
    assert [row["formatted"][m["start"] : m["start"] + m["length"]] for m in row["mask"]] == ["b", "c \\t"]
    plan = chat.digests(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_chat_query_has_the_hard_conversation(spark, sf):
    got = {x["conv_id"]: x for x in chat.op9_chat_formatting(spark, sf).collect()}
    hard = "\\### Assistant: </turn> ok"
    assert (got[-7]["n_turns"], got[-7]["loss_chars"], got[-7]["loss_sha256"]) == (2, len(hard), hashlib.sha256(hard.encode()).hexdigest())


# 10


def reference_encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}, special_tokens={})


def test_bpe_matches_tiktoken_on_hard_texts():
    r, enc, own = random.Random(10), reference_encoding(), bpe.tokenizer()
    alphabet = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u3000\u200b'sStTllreabcé12½一二😀.,-_(){}<>\\/"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(4000)]
    texts += ["", "a" * 3000, " " * 2999, "ab" * 700 + "'s", "\n" * 300 + "x", "é" * 900, "=" * 1000, "the" * 600, LONG]
    assert own.encode_batch(texts) == [enc.encode_ordinary(t) for t in texts]
    assert [own.decode(x) for x in own.encode_batch(texts)] == [t.encode() for t in texts]


def test_bpe_cache_may_overflow():
    enc = reference_encoding()
    own = bpe.Tokenizer(public_tokenizers.path(bpe.VOCABULARY))
    own.chunks.most = 500
    for i in range(5):
        texts = [f"word{i} other{j} third" for j in range(40)]
        assert own.encode_batch(texts) == [enc.encode_ordinary(t) for t in texts]


def test_bpe_of_long_unbroken_pieces():
    r, enc, own = random.Random(12), reference_encoding(), bpe.tokenizer()
    texts = ["".join(r.choice(letters) for _ in range(n)) for letters in ("abcdefghijklmnop", "etaoinshrdlu", "ab", "a", "abcdABCD", "éèàü", "=-", "0123456789") for n in (255, 256, 257, 258, 700, 9000)]
    assert own.encode_batch(texts) == [enc.encode_ordinary(t) for t in texts]


def test_bytes_that_are_not_utf8_count_as_replacement_characters(spark):
    raw = [b"a\xff b", b"\xe2 \xe2\x80 x", b"\xc2", b"ok \xf0\x9f", b"\x80\x80\x80 y\xc2\x85z"]
    ids, at = bpe.tokenizer().encode(pa.array(raw, pa.binary()))
    enc = reference_encoding()
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [enc.encode_ordinary(x.decode("utf-8", "replace")) for x in raw]
    got = bpe.round_trip(spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "doc_id long, text binary")).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in got} == {i: hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for i, x in enumerate(raw)}


def test_pair_table_finds_all_and_only_its_pairs():
    r = np.random.default_rng(0)
    pairs = np.unique(r.integers(0, 300, (5000, 2)), axis=0)
    t = bpe.PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs), dtype=np.int32))
    assert (t.find(pairs[:, 0], pairs[:, 1]) == np.arange(len(pairs))).all()
    known = set(map(tuple, pairs.tolist()))
    for a, b in r.integers(-1, 400, (2000, 2)).tolist():
        found = t.find(np.array([a]), np.array([b]))[0]
        assert (found != bpe.NONE) == ((a, b) in known)


def test_bpe_query(spark):
    enc = reference_encoding()
    for r in bpe.round_trip(odd(spark)).collect():
        if r["doc_id"] is not None:
            text = TEXTS[r["doc_id"]] or ""
            ids = enc.encode_ordinary(text)
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.round_trip(docs_of(spark, [])).count() == 0
    back = bpe.decode(bpe.encode(docs_of(spark), ["doc_id"]), ["doc_id"]).collect()
    assert all(bytes(r["bytes"]) == (TEXTS[r["doc_id"]] or "").encode() for r in back)


# pipeline and registration


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, kept, sf)
        assert made.columns == docs.columns, name
        rows = made.collect()
        kept = spark.createDataFrame(rows, docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
    run = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(str, last)) == sorted(map(str, run)) and run


def test_pipeline_of_odd_rows(spark, sf):
    kept = odd(spark)
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf)
    assert kept.count() > 0
    empty = docs_of(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 11))
    assert "pipeline" in entry.queries() and [n for n, _ in corpus_pipeline.STAGES]


def test_top_k_query_matches_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    want = con.execute(f"select query_id, rank, vec_id, score from ({topk.ORACLE})").fetchall()
    assert sorted(want) == sorted(map(tuple, topk.op4_exact_top_k(spark, sf).select("query_id", "rank", "vec_id", "score").collect()))
