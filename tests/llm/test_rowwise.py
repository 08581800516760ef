"""License, language, token count and quality operators."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest_llm import DATA, EDGES, LONG, make
from lakestar.llm import language_id, license_scan, quality_fm, queries
from lakestar.llm.common import word_hashes
from lakestar.llm.token_count import MergeCounter, token_counts

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = "aAbBÉéΣσς 's'll12½²̧é İ\x1c\x1f\x85　中文😀_-\n\t\xa0"


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(["<|endoftext|>", "<|startoftext|>", "  ", *ODD])
                    for _ in range(rng.randint(0, 60))) for _ in range(n)]


# ---- token counts


def test_counts_equal_the_library_on_documents_and_odd_texts(texts):
    counter, library = MergeCounter(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    sample = [*texts.values(), *odd_texts(3000)]
    expected = [len(e.ids) for e in library.encode_batch_fast(sample, add_special_tokens=False)]
    assert [counter.count(t) for t in sample] == expected


def test_counts_survive_a_full_memo(texts):
    small, large = MergeCounter(WORD_BPE), MergeCounter(WORD_BPE)
    small._chunks.size = small._words.size = 7
    for t in list(texts.values())[:20]:
        assert small.count(t) == large.count(t)


def test_count_rows(edges, empty):
    rows = token_counts(edges, WORD_BPE).collect()
    assert len(rows) == len(EDGES)
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_tokens, by[1].n_bytes, by[2].n_tokens) == (0, 0, 0)
    assert by[4].over_limit and by[4].n_bytes == len(LONG) and not by[5].over_limit
    assert by[8].n_bytes == len("é 中文 😀".encode())
    assert token_counts(empty, WORD_BPE).count() == 0


# ---- language


def test_forward_sums_all_segmentations():
    pieces = language_id.Pieces(["▁", "a", "b", "ab", "▁a"])
    rng = np.random.default_rng(3)
    probs = np.vstack([rng.random((5, 2)), np.zeros((1, 2))])
    model = language_id.Model(["x", "y"], np.zeros(2), probs)
    ids = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4}

    def every(word):
        if not word:
            return np.ones(2)
        total = np.zeros(2)
        for n in range(1, len(word) + 1):
            if word[:n] in ids:
                total = total + probs[ids[word[:n]]] * every(word[n:])
            elif n == 1:
                total = total + language_id.UNKNOWN * every(word[1:])
        return total

    words = ["ab", "aab", "b", "zab", "abab"]
    found = np.exp(model.log_likelihoods(pieces, words))
    assert np.allclose(found, [every("▁" + w) for w in words])


@pytest.mark.parametrize("total", [1e7, 1e8, 1e10])
def test_long_words_of_rare_letters_keep_their_likelihood(total):
    pieces = language_id._pieces(PIECES)
    rare = language_id.SMOOTHING / total
    probs = np.full((pieces.size + 1, 2), 1.0 / pieces.size)
    probs[:, 0] = rare
    probs[-1] = 0.0
    model = language_id.Model(["x", "y"], np.zeros(2), probs)
    words = ["法" * 40, "щ" * 40, "a" * 40, "a"]
    logs = model.log_likelihoods(pieces, words)
    assert np.isfinite(logs).all()
    # At least the segmentation into single letters; at most all segmentations of likeliest pieces.
    letters = 41 * np.log(min(rare, language_id.UNKNOWN))
    assert (logs[:3, 0] >= letters - 1e-6).all() and (logs <= 41 * np.log(2)).all()
    counts = model.expected_counts(pieces, words, np.ones((4, 2)))
    assert np.isfinite(counts).all() and (counts >= 0).all()
    _, scores = language_id.Scorer(pieces, model).score(words)
    assert all(0 <= x <= 1 for x in scores)


def test_held_out_languages(spark, duck):
    rows = queries.op2_language_unigrams(spark, DATA).collect()
    truth = dict(duck.execute("select doc_id, lang from documents").fetchall())
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, edges, empty):
    model = language_id.learn(edges, PIECES)
    rows = language_id.predict(edges, PIECES, model).collect()
    assert len(rows) == len(EDGES)
    by = {r.doc_id: r.lang_pred for r in rows}
    assert [by[i] for i in (1, 2, 3, 7)] == ["und"] * 4 and by[4] == "en"
    assert language_id.identify(empty, PIECES).count() == 0
    nothing = make(spark, [(1, "some words", None)])
    assert language_id.identify(nothing, PIECES).first().lang_pred == "und"
    kept = language_id.known_language(edges, PIECES, model, 0.5)
    assert kept.columns == edges.columns and kept.count() == 6


# ---- quality


def test_sum_of_squares_equals_the_pairwise_sum():
    rng = np.random.default_rng(0)
    x, v = rng.normal(size=(3, 6)), rng.normal(size=(6, 4))
    m = quality_fm.Machine(0.3, rng.normal(size=6), v, np.zeros(6), np.ones(6))
    pairs = [sum((v[i] @ v[j]) * r[i] * r[j] for i in range(6) for j in range(i + 1, 6)) for r in x]
    assert np.allclose(m.logits(x), 0.3 + x @ m.w + pairs)


def test_gradient_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = np.zeros((400, quality_fm.BUCKETS + len(quality_fm.STATS)))
    x[:, :2] = rng.choice([-1.0, 1.0], (400, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # no linear rule tells these apart
    m = quality_fm.fit(x, y)
    assert ((m.scores(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_held_out_quality(spark, duck):
    rows = queries.op7_quality_fm(spark, DATA).collect()
    truth = dict(duck.execute("select doc_id, quality from labels").fetchall())
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_quality_edges(spark, edges, empty):
    labels = spark.createDataFrame([(2, 0, 0), (4, 1, None), (None, 1, 0), (5, None, 1), (4, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = quality_fm.score(edges, quality_fm.learn(edges, labels)).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    assert quality_fm.assess(empty, labels).count() == 0
    assert quality_fm.assess(edges, labels.limit(0)).count() == len(EDGES)


# ---- licenses


def test_rising_subsequence_is_longest():
    rng = random.Random(5)
    for _ in range(200):
        v = rng.sample(range(30), rng.randint(0, 12))
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max([best[j] for j in range(i) if v[j] < v[i]], default=0)
        got = [v[i] for i in license_scan._rising(v)]
        assert got == sorted(got) and len(got) == max(best, default=0)


def test_alignment_rises_and_matches_equal_words():
    rng = random.Random(6)
    for _ in range(200):
        a = [rng.randrange(9) for _ in range(rng.randint(0, 20))]
        b = [rng.randrange(9) for _ in range(rng.randint(0, 20))]
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert license_scan.align([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_each_template_is_found_inside_a_long_text(name):
    scanner = license_scan.Scanner()
    for text in license_scan.TEMPLATES[name]:
        words = text.split()
        words[len(words) // 2:len(words) // 2] = ["Acme"]
        found = scanner.scan(LONG + ". " + " ".join(words) + " " + LONG)
        assert found and found[0][0] == name and found[0][1] >= 0.8
    twice = scanner.scan((" ".join(license_scan.TEMPLATES[name]) + " ") * 2)
    assert sum(m[0] == name for m in twice) >= 2


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_common_words_before_a_license_do_not_cut_it(name):
    scanner = license_scan.Scanner()
    for text in license_scan.TEMPLATES[name]:
        size = len(word_hashes(text))
        for gap in (1, size // 2, size - 1, size + size // 5):
            for lead in dict.fromkeys(("under", "by", "the", text.split()[0], text.split()[-1])):
                before = " ".join([lead, *(f"q{i}" for i in range(gap))])
                at = len(word_hashes(before))
                found = scanner.scan(f"{before} {text} zz end of it")
                assert found[0] == (name, 1.0, size, at, at + size), (lead, gap)


def test_licenses_lists_only_those_that_the_text_names(spark):
    texts = {name: " ".join(ts) for name, ts in license_scan.TEMPLATES.items()}
    cases = [(t, name) for name, ts in license_scan.TEMPLATES.items() for t in (*ts, texts[name])]
    cases += [(f"Licensed under the {name} License.", "") for name in ("ISC", "Foo")]
    cases += [("Licensed under the BSD 2-Clause License.", ""), ("Licensed under CC BY-SA 4.0.", ""),
              ("Licensed under the Apache License 2.0.", "Apache-2.0"),
              ("Licensed under the 3-Clause BSD License.", "BSD-3-Clause"),
              ("This work is licensed under the GNU Lesser General Public License, version 3.", ""),
              ("This work is licensed under the GNU General Public License, version 2.", ""),
              ("Released under the MIT License. Also Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0,MIT")]
    docs = make(spark, [(i, t, None) for i, (t, _) in enumerate(cases)])
    rows = {r.doc_id: r.licenses for r in license_scan.scan_licenses(docs).collect()}
    assert [(t, rows[i]) for i, (t, _) in enumerate(cases)] == cases


HEADER = ("This {0} is free software{1} you can redistribute it and/or modify it under the terms of "
          "the GNU {2} Public License as published by the Free Software Foundation{1} either version "
          "{3} of the License, or (at your option) any later version. This {0} is distributed in the "
          "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
          "of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2} Public License "
          "for more details.")


@pytest.mark.parametrize(("name", "parts"), [
    ("GPL-2.0", ("program", ";", "General", "2")), ("GPL-3.0", ("program", ":", "General", "3")),
    ("LGPL-2.1", ("library", ";", "Lesser General", "2.1")),
    ("LGPL-3.0", ("program", ":", "Lesser General", "3")),
    ("AGPL-3.0", ("program", ":", "Affero General", "3"))])
def test_headers_of_one_family_are_told_apart(name, parts):
    found = license_scan.Scanner().scan("# my file\n" + HEADER.format(*parts) + "\nimport os\n")
    assert [m[0] for m in found] == [name] and found[0][1] >= 0.97


def test_an_edited_text_stays_the_license_of_most_clauses():
    full = license_scan.TEMPLATES["BSD-3-Clause"][1].replace("copyright holder nor", "Example Org. nor")
    assert [m[0] for m in license_scan.Scanner().scan("Copyright 2020. " + full)] == ["BSD-3-Clause"]
    two = license_scan.TEMPLATES["BSD-2-Clause"][0]
    assert [m[0] for m in license_scan.Scanner().scan(two)] == ["BSD-2-Clause"]
    mit = license_scan.TEMPLATES["MIT"]
    assert license_scan.Scanner().scan(mit[1])[0][2] > license_scan.Scanner().scan(mit[0])[0][2]


def test_license_rows(spark, edges, empty, duck):
    rows = license_scan.scan_licenses(edges).collect()
    assert len(rows) == len(EDGES) and all(r.license is None and r.coverage == 0 for r in rows)
    assert license_scan.scan_licenses(empty).count() == 0
    found = {r.doc_id for r in queries.op1_license_scan(spark, DATA).collect() if r.license}
    lines = duck.execute("select doc_id from documents where text ilike '%licen_e%'").fetchall()
    assert found == {i for i, in lines}
