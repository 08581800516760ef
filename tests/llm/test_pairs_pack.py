"""Near-dedup, packing, neighbours, fingerprints and the pipeline."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest_llm import DATA, EDGES, make
from lakestar.llm import best_fit, collision_ann, order_minhash, paragraph_sketch, queries
from lakestar.llm.common import word_hashes

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


# ---- near-dedup


def jaccard(a, b):
    a, b = (set(order_minhash.shingles(word_hashes(t)).tolist()) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 0.0


def prose(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def vary(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[at:at + (kind != 0)] = [f"z{rng.randrange(10 ** 6)}"] if kind != 1 else []
    return words


def test_aligned_similarity_is_the_jaccard_of_edited_texts():
    rng = random.Random(1)
    for _ in range(150):
        a = prose(rng, rng.randint(5, 200))
        b = vary(rng, a, rng.randint(0, 5))
        wa, wb = (word_hashes(" ".join(w)) for w in (a, b))
        j = jaccard(" ".join(a), " ".join(b))
        s = order_minhash.similarity(wa, wb)
        assert (s >= 0.8) == (j >= 0.8), (s, j)
    # The same shingles in another order are no small edit.
    blocks = [prose(rng, 60) for _ in range(12)]
    a, b = sum(blocks, []), sum(blocks[::-1], [])
    wa, wb = (word_hashes(" ".join(w)) for w in (a, b))
    assert jaccard(" ".join(a), " ".join(b)) >= 0.8 > order_minhash.similarity(wa, wb)


@pytest.mark.parametrize("n, x", [(1000, 81), (1000, 101), (100, 7), (400, 30), (60, 3)])
def test_moved_head_and_tail_blocks_keep_their_similarity(n, x):
    rng = random.Random(n + x)
    a = [f"u{rng.randrange(10 ** 9)}" for _ in range(n)]
    tail = [f"v{rng.randrange(10 ** 9)}" for _ in range(x)]
    for b in (a[x:] + tail, tail + a[:n - x], tail[:x // 2] + a[x // 2:n - x // 2] + tail[x // 2:]):
        j = jaccard(" ".join(a), " ".join(b))
        assert j >= 0.8
        wa, wb = (word_hashes(" ".join(w)) for w in (a, b))
        assert order_minhash.similarity(wa, wb) == pytest.approx(j)
        assert order_minhash.similarity(wb, wa) == pytest.approx(j)


def test_runs_are_an_optimal_alignment():
    rng = random.Random(2)
    for _ in range(150):
        a = np.array([rng.randrange(4) for _ in range(rng.randint(1, 14))])
        b = np.array([rng.randrange(4) for _ in range(rng.randint(1, 14))])
        cost = np.zeros((len(a) + 1, len(b) + 1), int)
        cost[:, 0], cost[0] = range(len(a) + 1), range(len(b) + 1)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            cost[i + 1, j + 1] = min(cost[i, j] + (a[i] != b[j]), cost[i, j + 1] + 1, cost[i + 1, j] + 1)
        best = int(cost[-1, -1])
        assert order_minhash._runs(a, b, best) is not None
        assert best == 0 or order_minhash._runs(a, b, best - 1) is None


def classes_of(docs):
    return dict(tuple(r) for r in order_minhash.duplicate_classes(docs).collect())


def brute_classes(texts):
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if texts[a] == texts[b] or jaccard(texts[a], texts[b]) >= 0.8:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_classes_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = prose(rng, rng.randint(30, 120))
        rows += [base, base] + [vary(rng, base, rng.randint(1, 2)) for _ in range(rng.randint(0, 4))]
        rows.append(vary(rng, base, 12))
    # One large group whose copies are near the original, not near each other.
    hub = prose(rng, 150)
    rows += [hub] + [vary(rng, hub, 4) for _ in range(40)]
    rng.shuffle(rows)
    texts = {i: " ".join(w) for i, w in enumerate(rows)}
    found = classes_of(make(spark, [(i, t, None) for i, t in texts.items()]))
    assert found == brute_classes(texts)


@pytest.mark.parametrize("block", [16, 1024])
def test_small_clusters_among_texts_of_one_template_are_all_found(spark, monkeypatch, block):
    monkeypatch.setattr(order_minhash, "BLOCK", block, raising=False)
    rng = random.Random(4)
    passage = prose(rng, 110)
    rows = []
    for g in range(150):
        own = passage + [f"g{g}x{i}" for i in range(30)]
        rows.append(own)
        if g % 5 == 0:
            rows += [vary(rng, own, 2) for _ in range(1 + g % 2)]
    rng.shuffle(rows)
    texts = {i: " ".join(w) for i, w in enumerate(rows)}
    truth = brute_classes(texts)
    assert len(set(truth.values())) > 120
    assert classes_of(make(spark, [(i, t, None) for i, t in texts.items()])) == truth


def test_pairs_that_are_passed_over_are_not_alike():
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        base = prose(rng, rng.randint(5, 400))
        texts += [base, *(vary(rng, base, rng.randint(1, 14)) for _ in range(5))]
    words = [word_hashes(" ".join(t)) for t in texts]
    facts = sorted(((*order_minhash.parities(w), i) for i, w in enumerate(words)), key=lambda f: f[0])
    at = [i for *_, i in facts]
    n = len(facts)
    found = order_minhash._near_rows(np.zeros(n), np.full(n, -1), np.arange(n),
                                     np.array([f[0] for f in facts]), np.stack([f[1] for f in facts]))
    asked = {frozenset((at[x], at[y])) for x, y in zip(*found)}
    alike = {frozenset((i, j)) for i, j in itertools.combinations(range(n), 2)
             if jaccard(" ".join(texts[i]), " ".join(texts[j])) >= 0.8}
    assert alike <= asked and len(asked) < n * (n - 1) / 20


def test_class_edges(spark, edges, empty):
    rows = order_minhash.duplicate_classes(edges).collect()
    assert len(rows) == len(EDGES)
    by = dict(map(tuple, rows))
    assert by == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, None: None}
    assert order_minhash.duplicate_classes(empty).count() == 0
    kept = order_minhash.deduplicated(edges)
    assert kept.columns == edges.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 7, 8]


def test_an_id_with_several_texts_keeps_the_rows_of_their_classes(spark):
    a, b, c, d = ("alpha beta gamma delta one", "this is another text", "third of them", "and the last")
    docs = make(spark, [(1, a, "en"), (5, a, "en"), (5, b, "en"), (7, c, "en"), (7, d, "en"), (7, d, "fr"),
                        (8, b, "en"), (9, None, "en")])
    kept = order_minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [
        (1, a), (5, b), (7, d), (7, c), (9, "")]


# ---- packing


def bfd(sizes, capacity):
    gaps, bins = [], 0
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, s)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        bins += gap == capacity
        bisect.insort(gaps, gap - s)
    return bins


def packed(spark, sizes, capacity):
    """Place rows that come from three tasks; returns the number of sequences."""
    seen, rows = {}, []
    for i, n in enumerate(sizes):
        task = i % 3
        rows.append((i, n, task, seen.setdefault((task, n), 0)))
        seen[task, n] += 1
    items = spark.createDataFrame(rows, "id long, length long, task int, nth long")
    out = best_fit.place(items, capacity).collect()
    assert sorted(r.id for r in out) == list(range(len(sizes)))
    ends = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + sizes[r.id]
    assert max(ends.values(), default=0) <= capacity
    return len(ends)


@pytest.mark.parametrize("low,high,block", [(1, 64, 1 << 16), (1, 12, 7), (20, 30, 1), (9, 9, 64)])
def test_placement_is_sequential_best_fit_decreasing(spark, monkeypatch, low, high, block):
    monkeypatch.setattr(best_fit, "RANK_BLOCK", block)
    rng = random.Random(low)
    sizes = [rng.randint(low, high) for _ in range(300)]
    assert packed(spark, sizes, 64) == bfd(sizes, 64)


def test_intervals_equal_best_fit_decreasing_in_many_cases():
    rng = random.Random(7)
    for _ in range(300):
        capacity = rng.randint(5, 60)
        low = rng.randint(1, capacity)
        sizes = [rng.randint(low, capacity) for _ in range(rng.randint(0, 200))]
        counts = {n: sizes.count(n) for n in set(sizes)}
        ends, ranks = {}, dict.fromkeys(counts, 0)
        for n, first, end, sequence, offset in best_fit.intervals(counts, capacity):
            assert first == ranks[n] and end > first
            ranks[n] = end
            for i in range(end - first):
                assert ends.get(sequence + i, 0) == offset
                ends[sequence + i] = offset + n
        assert ranks == counts and max(ends.values(), default=0) <= capacity
        assert len(ends) == bfd(sizes, capacity)


def test_pieces_are_the_library_s_ids(spark, texts):
    library = Tokenizer.from_file(BYTE_BPE)
    odd = {10 ** 6: "", 10 ** 6 + 1: "a <|endoftext|> b", 10 ** 6 + 2: "  x \x1c y\n\n z's\xa0q "}
    docs = make(spark, [(i, t, None) for i, t in [*list(texts.items())[:60], *odd.items()]])
    rows = {}
    for r in best_fit.pieces(docs, BYTE_BPE).collect():
        rows.setdefault(r.doc_id, []).append(r)
    for i, found in rows.items():
        text = odd.get(i, texts.get(i))
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        found.sort(key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(len(found)))
        assert sum(r.length for r in found) == len(ids)
        assert all(r.length == 2048 for r in found[1:])
        for r in found:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())


def test_pack_query_and_edges(spark, edges, empty):
    rows = queries.op8_best_fit(spark, DATA).collect()
    sequences = len({r.sequence_id for r in rows})
    assert sequences <= math.ceil(1.02 * sum(r.length for r in rows) / 2048)
    out = best_fit.pack(edges, BYTE_BPE).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out) >= len(EDGES)
    assert sorted(r.length for r in out if r.doc_id in (1, 2)) == [1, 1]
    assert best_fit.pack(empty, BYTE_BPE).count() == 0


# ---- neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double, block int")


def test_recall_and_scores(spark, duck):
    rows = queries.op9_collision_ann(spark, DATA).collect()
    data = dict(duck.execute("select vec_id, embedding from embeddings").fetchall())
    ids = np.array(list(data))
    x = np.array([np.array(v, float) for v in data.values()])
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        mine = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and len(mine) == 20
        scores = x @ x[ids == q][0]
        exact = sorted((-s, i) for s, i in zip(scores, ids, strict=True) if i != q)[:20]
        hits += len({i for _, i in exact} & {m[1] for m in mine})
        total += 20
        assert all(abs(s - scores[ids == i][0]) < 1e-12 for _, i, s in mine)
        assert [m[1] for m in mine] == [i for _, i, in sorted((-m[2], m[1]) for m in mine) for i in [i]]
    assert hits >= 0.9 * total


def test_vector_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]),
            (6, [1.0, None]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (None, [1.0, 1.0]), (9, [0.5, 9.0])]
    out = collision_ann.nearest(vectors(spark, [(i, v, 0.0, 1) for i, v in rows])).collect()
    by = {}
    for r in sorted(out, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by == {0: [(7, 1.0), (8, 1.0), (9, 0.5), (20, 0.0)],
                  20: [(9, 18.0), (0, 0.0), (7, 0.0), (8, 0.0)]}
    assert collision_ann.nearest(vectors(spark, [])).count() == 0


def test_a_query_ends_at_the_same_step_wherever_it_begins():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 6)) * rng.uniform(0.1, 3.0, (700, 1))
    block = collision_ann.Block(np.arange(700), x)
    lifted = np.column_stack([x, np.sqrt(np.maximum(block.top ** 2 - (x ** 2).sum(axis=1), 0))])
    projected = lifted @ block.directions
    for q in x[:40]:
        centres = np.append(q * block.top / np.linalg.norm(q), 0.0) @ block.directions
        width = block.widths[0]
        while True:  # all windows counted anew at every step
            inside = (np.abs(projected - centres) <= width).sum(axis=1)
            if (inside >= collision_ann.THRESHOLD).sum() >= 350:
                break
            width *= collision_ann.WIDEN
        expected = {tuple(v) for v in x[inside >= collision_ann.THRESHOLD]}
        for begin in (0, 3, 9, 40):
            block.step = begin
            assert {tuple(v) for v in block.vectors[block.candidates(q, 350)]} == expected
            assert block.step < 40


def test_many_copies_and_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(collision_ann, "BLOCK", 64)
    monkeypatch.setattr(collision_ann, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x *= rng.uniform(0.5, 2.0, (300, 1)).astype(np.float32)
    x[100:220] = 9 * x[100]
    out = collision_ann.nearest(vectors(spark, [(i, v.tolist(), None, None) for i, v in enumerate(x)]))
    mine = {}
    for r in out.collect():
        mine.setdefault(r.query_id, {})[r.rank] = r.vec_id
    hits = 0
    for q in range(0, 300, 20):
        s = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        exact = [i for _, i in sorted((-v, i) for i, v in enumerate(s) if i != q)[:20]]
        hits += len(set(exact) & set(mine[q].values()))
    assert hits >= 0.9 * 20 * 15
    assert [mine[100][k] for k in range(1, 21)] == list(range(101, 121))  # ties: smaller ids


# ---- fingerprints


def test_peeling_recovers_the_difference():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 40, 300):
        common = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
        only_a, only_b = paragraph_sketch.difference(np.append(common, a), np.append(common, b))
        assert set(only_a.tolist()) == set(a.tolist()) and set(only_b.tolist()) == set(b.tolist())


def brute_likeness(a, b):
    a, b = set(paragraph_sketch.digests(a).tolist()), set(paragraph_sketch.digests(b).tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("partitions", [1, 5])
def test_fingerprint_rows(spark, texts, partitions):
    some = dict(list(texts.items())[:70])
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    docs = make(spark, [(i * 3, t, None) for i, t in some.items()]).repartition(4)
    rows = {r.doc_id: r for r in paragraph_sketch.fingerprints(docs).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    order = sorted(some)
    assert len(rows) == len(some)
    for i, n in zip(order, order[1:] + order[:1], strict=True):
        r, text, after = rows[i * 3], some[i], some[n]
        edited = text[:len(text) - len(text) // 4] + after[:len(text) // 4]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - brute_likeness(text, edited)) < 1e-12
        assert abs(r.near_next - brute_likeness(text, after)) < 1e-12


def test_fingerprint_edges(spark, edges, empty):
    rows = paragraph_sketch.fingerprints(edges).collect()
    assert len(rows) == len(EDGES)
    assert len({r.fingerprint for r in rows if r.doc_id in (5, 6)}) == 1
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1
    assert paragraph_sketch.fingerprints(empty).count() == 0
    one = paragraph_sketch.fingerprints(make(spark, [(1, "abcdefgh", None)])).first()
    assert one.near_next == 1.0
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


# ---- pipeline


def test_pipeline_stages(spark, edges, empty):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, DATA)
        if name != "packing":
            assert after.columns == before.columns
        if name == "language_id":
            assert after.count() >= 0.99 * before.count()
        if name == "near_dedup":
            classes = order_minhash.duplicate_classes(before).select("class_id").distinct().count()
            assert after.count() == classes < before.count()
        if name == "secret_scan":
            from lakestar.llm import secret_ledger
            left = secret_ledger.scan(after).where("spans <> ''").count()
            assert after.count() == before.count() and left == 0
        before = after.checkpoint()
    assert before.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
                              "offset"]
    for rows in (edges, empty):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, DATA)
        assert rows.count() >= 0
