"""Spelling variants, toxicity by labelled neighbours, periodic runs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

from conftest_llm import DATA, EDGES, LONG, make
from lakestar.llm import periodic_runs, queries, spelling_variants, toxic_neighbours
from lakestar.llm.common import read_table

# ---- spelling variants


def edits_apart(a, b):
    """Whether one inserted, deleted or replaced code point turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_variants(texts, slip=True):
    counts = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip and h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += len(run) >= 6
    words = {w: n for w, n in counts.items() if n >= 5}
    by_size = defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    forms, out = {}, {}
    for w, n in words.items():
        near = [o for k in (-1, 0, 1) for o in by_size[len(w) + k] if edits_apart(w, o)]
        best = min(near, key=lambda o: (-words[o], o)) if near else None
        forms[w] = best if near and words[best] >= 5 * n else None
        out[w] = (n, len(near), words[best] if forms[w] else None)
    rows = set()
    for w, (n, n_near, form_n) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, n, n_near, form_n))
    return rows


def as_rows(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len({r.word for r in rows})
    return {tuple(r) for r in rows}


def test_variants_equal_brute_force_and_sql(spark, texts, duck):
    found = as_rows(queries.op11_permuterm_variants(spark, DATA))
    assert found == brute_variants(texts.items())
    assert found == set(duck.execute(spelling_variants.oracle()).fetchall())


def test_variants_of_dense_words(spark):
    """Few letters, many stretches of equal ones, chains of forms, words beyond SPELLED."""
    rng = random.Random(4)
    lines = []
    for _ in range(250):
        word = "".join(rng.choice("aabé") for _ in range(rng.randint(5, 8)))
        lines += [word] * rng.choice([1, 5, 6, 30, 160])
    long = "".join(rng.choice("xyz") for _ in range(64))
    for word, n in ((long, 900), (long + "z", 30), (long[:9] + "q" + long[9:] + "z", 6),
                    (long[1:], 150), ("v" * 90, 5), ("v" * 91, 25), ("v" * 92, 125)):
        lines += [word] * n
    rng.shuffle(lines)
    rows = [(k, " ".join(lines[k::7]), "en") for k in range(7)]
    found = as_rows(spelling_variants.variants(make(spark, rows)))
    assert found == brute_variants([(i, t) for i, t, _ in rows], slip=False)
    by = {r[0]: r for r in found}
    assert by["v" * 90][2] == "v" * 92 and by[long + "z"][1] == long
    assert any(r[2] not in (r[0], r[1]) for r in found)


def test_variant_edges(spark, edges, empty):
    assert as_rows(spelling_variants.variants(empty)) == set()
    found = as_rows(spelling_variants.variants(edges, spelling_variants.slips))
    assert found == brute_variants([(i, t) for i, t, _ in EDGES])
    huge = make(spark, [(1, "y" * 30_000 + " " + "y" * 29_999, "en")] * 5)
    assert {(r[3], r[4]) for r in as_rows(spelling_variants.variants(huge))} == {(5, 1)}


def test_a_group_holds_one_word_for_each_letter():
    words = ["abcdef", "abXdef", "abdef", "abccef"]
    seen = defaultdict(set)
    for w in words:
        for prefix, skipped, _ in spelling_variants.rotations(w):
            seen[prefix].add((w, skipped))
    assert seen["def$ab"] == {("abcdef", True), ("abXdef", True), ("abdef", False)}


# ---- toxicity


def test_block_max_search_equals_scoring_all():
    rng = np.random.default_rng(2)

    def vector():
        terms = np.sort(rng.choice(30, rng.integers(0, 7), replace=False))
        w = rng.integers(1, 4, len(terms)).astype(float)
        return terms, w / np.sqrt((w ** 2).sum()) if len(terms) else w

    examples = [vector() for _ in range(700)]
    index = toxic_neighbours.Index(examples, 31)
    dense = np.zeros((700, 31))
    for k, (t, w) in enumerate(examples):
        dense[k, t] = w
    for n in range(400):
        terms, weights = vector()
        without = int(rng.integers(0, 700)) if n % 2 else -1
        cosines = np.round(dense[:, terms] @ weights, 12)
        if without >= 0:
            cosines[without] = 0
        expected = [p for p in np.lexsort((np.arange(700), -cosines)) if cosines[p] > 0][:15]
        places, found = index.search(terms, weights, 15, without)
        assert places.tolist() == expected and np.allclose(found, cosines[expected])


def test_toxic_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    rows = {r.doc_id: r for r in queries.op12_toxic_neighbours(spark, sf).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    held = [(rows[r.doc_id].predicted, r.toxic) for r in labels.collect()
            if r.toxic is not None and r.doc_id in rows and rows[r.doc_id].held_out]
    toxic = sum(y for _, y in held)
    assert sum(p and y for p, y in held) >= 0.6 * toxic
    assert sum(p and not y for p, y in held) <= 0.02 * len(held) + 1


def test_toxic_evidence_and_bounds(spark):
    rows = [(k, ("awful nasty" if k % 4 == 0 else "kind gentle") + f" words filler{k % 7}", "en")
            for k in range(200)]
    docs = make(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(150)], "doc_id long, toxic int")
    model = toxic_neighbours.learn(docs, labels, toxic_docs=20, clean_docs=30)
    assert len(model.ids) == 50 and int(model.toxic.sum()) == 20
    found = toxic_neighbours.score(docs, model).collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in found)
    told = next(r for r in found if r.doc_id == 196)
    assert set(told.stems) & {"awful$", "nasty$"} and all(n.toxic == 1 for n in told.nearest)


def test_toxic_edges(spark, edges, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 1), (6, 0), (8, 0), (1, 1), (None, 1), (99, 0)],
                                   "doc_id long, toxic int")
    out = toxic_neighbours.assess(edges, labels).collect()
    assert len(out) == len(EDGES) and all(0 <= r.score <= 1 for r in out)
    assert toxic_neighbours.assess(empty, labels).count() == 0
    none = toxic_neighbours.assess(edges, labels.where("toxic > 5")).collect()
    assert {r.score for r in none} == {0.0}
    ones = toxic_neighbours.assess(edges, labels.where("toxic = 1")).collect()
    assert {r.score for r in ones} == {1.0}


def test_reading_postings_through_finds_the_same(monkeypatch):
    rng = np.random.default_rng(5)

    def vector():
        terms = np.sort(rng.choice(40, int(rng.integers(1, 9)), replace=False))
        weights = rng.integers(1, 5, len(terms)).astype(float)
        return terms, weights / np.sqrt((weights ** 2).sum())

    index = toxic_neighbours.Index([vector() for _ in range(900)], 40)
    queries_ = [(*vector(), k - 1) for k in range(200)]

    def found(share):
        monkeypatch.setattr(toxic_neighbours, "READ_THROUGH", share)
        return [(p.tolist(), c.tolist()) for p, c in (
            index.search(t, w, 15, without) for t, w, without in queries_)]

    assert index.common and found(-1.0) == found(2.0)


def test_words_of_latin_texts_are_those_of_the_general_rule():
    for text in ("", "x1y_z \u00b2\u00bd\u00aa\u00ba \u00b5 STRA\u00dfE \u00c9t\u00e9", "\u0130stanbul \u03a9 na\u00efve",
                 "".join(map(chr, range(256))), "".join(map(chr, range(0x250)))):
        assert toxic_neighbours.words_of(text) == Counter(
            toxic_neighbours._WORD.findall(text.lower()))
    assert toxic_neighbours._LATIN_WORD.findall("\u00c9a 1") == ["\u00c9a"]


# ---- periodic runs


def brute_runs(words):
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            k = i
            while k + p < n and words[k] == words[k + p]:
                k += 1
            length = k + p - i
            if k > i and length >= max(24, 3 * p):
                found.setdefault((i, length), p)
            i = k + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def odd_words(rng):
    words = []
    for _ in range(rng.randint(0, 8)):
        if rng.random() < 0.4:
            words += [rng.randint(0, rng.choice([1, 3, 50])) for _ in range(rng.randint(0, 40))]
        else:
            block = [rng.randint(0, 3) for _ in range(rng.randint(1, 20))]
            words += (block * rng.randint(1, 12))[:rng.randint(1, 200)]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        words = odd_words(rng)
        assert [tuple(r) for r in periodic_runs.runs_of(np.array(words, np.int64)).tolist()] == brute_runs(words)


def test_runs_of_a_text_beyond_the_ready_grid():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 50, 9000)
    words[1000:7000] = words[1000 + (np.arange(1000, 7000) - 1000) % 1400]
    words[8000:8100] = 7
    words[7999], words[8100] = 1, 1
    assert [tuple(r) for r in periodic_runs.runs_of(words).tolist()] == brute_runs(words.tolist())


def test_extensions_equal_comparison_word_by_word():
    rng = random.Random(8)
    for _ in range(100):
        n = rng.randint(1, 300)
        words = np.array([rng.randint(0, rng.choice([0, 1, 2])) for _ in range(n)])
        i = np.array([rng.randrange(n) for _ in range(50)])
        j = np.array([rng.randint(a + 1, n) for a in i])
        found = periodic_runs.Extensions(words).ahead(i, j)
        for a, b, k in zip(i, j, found, strict=True):
            assert (words[a:a + k] == words[b:b + k]).all()
            assert b + k == n or words[a + k] != words[b + k]


def test_every_difference_lies_in_the_cover():
    cover = np.flatnonzero(periodic_runs._IN_COVER)
    assert set(((cover[:, None] - cover) % periodic_runs.COVER).ravel()) == set(range(periodic_runs.COVER))


def brute_digest(doc_id, text):
    words = [w for w in re.split("[ \t-\r]+", text or "") if w]
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    dropped = {k for s, n, p in runs for k in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
    return (doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_run_digests_of_documents(spark, texts):
    found = {tuple(r) for r in queries.op13_periodic_runs(spark, DATA).collect()}
    assert found == {brute_digest(i, t) for i, t in texts.items()}
    assert any(r[1] for r in found)


def test_run_edges(spark, edges, empty):
    assert periodic_runs.run_digests(empty).count() == 0
    found = [tuple(r) for r in periodic_runs.run_digests(edges).collect()]
    assert len(found) == len(EDGES) and [r[1:6] for r in found if r[0] == 4] == [(1, 0, 60_000, 10, 6_000_000)]
    assert sorted((r for r in found if r[0] != 4), key=str) == sorted(
        (brute_digest(i, t) for i, t, _ in EDGES if t != LONG), key=str)
    whole = {r.doc_id: r for r in periodic_runs.find_runs(edges).collect()}
    assert [tuple(r) for r in whole[4].runs] == [(0, 60_000, 10)]
    assert whole[4].collapsed == " ".join(LONG.split()[:10]) and whole[1].n_words == 0


def test_every_document_has_its_row(spark, texts):
    assert queries.op13_periodic_runs(spark, DATA).count() == len(texts)
    assert queries.op12_toxic_neighbours(spark, DATA).count() == len(texts)
