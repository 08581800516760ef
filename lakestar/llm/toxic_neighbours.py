"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

**Terms.** A word gives the stem (a prefix, or the whole word) that tells toxic examples apart
best, by the likelihood-ratio statistic over the examples' document frequencies; words without
such a stem all give one background term.  A text's vector holds the root of each stem's count
times its inverse document frequency, and ``BACKGROUND`` times the root of the background count,
at unit length; so one chance hit in a long text points elsewhere than several in a short one.

**Index.** Examples stand in blocks of consecutive places; every term has its postings by block
and, of each block, the greatest weight.  A search visits blocks by falling bound (the query's
weights times the blocks' greatest) and leaves out those whose bound cannot reach the k-th best:
the result is exactly that of scoring every example.  Where the bounds leave many blocks, the
terms' postings are read through instead of block by block.  Ties go to the earlier place.

**Score.** The ``NEIGHBOURS`` nearest vote by their cosine, examples of a class that was sampled
thinner counting more; the vote goes through a logistic curve fitted on the examples, each asked
without itself.  The nearest examples and the stems found come back as evidence.

Learning takes at most ``TOXIC_DOCS`` and ``CLEAN_DOCS`` labelled documents (lowest id hashes);
all documents are then scored in one narrow pass.

Defined cases: null texts count as empty; a text without a word has no neighbours and scores the
known share; rows without a label, without text or with a null id are not learned from; an id
with several labels is toxic if one says so, one with several texts counts with the smallest;
without both classes the score is the known share of label 1 (0 without labels); repeated rows
are each scored; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestar.llm.common import batches, id_and_text, id_mod, ship, stored

FOLDS, HELD_FOLD = 5, 0
THRESHOLD = 0.5
#: Learning: at most so many labelled documents of either class (lowest id hashes).
TOXIC_DOCS, CLEAN_DOCS = 3000, 6000
#: Stems: prefixes of so many letters, and whole words up to a length; seen in at least so many
#: examples, with at least that statistic (about one in 10,000 by chance); at most so many.
SHORTEST, LONGEST, WHOLE, LEAST_SEEN, LEAST_G2, MOST_STEMS = 4, 8, 32, 3, 15.0, 4096
BACKGROUND, NEIGHBOURS, EVIDENCE = 0.7, 15, 3
#: Examples of a block; blocks that a search scores first; prior weight of the known share in a
#: vote.
BLOCK, FIRST_BLOCKS, PRIOR = 32, 4, 0.5

#: Share of the blocks left by the bounds from which a search reads whole postings; share of the
#: examples from which a term's postings also stand as one weight per example.
READ_THROUGH, COMMON = 0.25, 0.1

#: Words whose stem a task remembers.
REMEMBERED = 200_000

_WORD = re.compile(r"[^\W\d_]+")
#: The same runs in texts of code points below 256, by a plain set of characters (faster).
_LATIN_WORD = re.compile("[" + "".join(
    re.escape(chr(c)) for c in range(256) if _WORD.match(chr(c))) + "]+")
#: Closes a whole word; no letter.
_END = "$"
_PLACES, _ROUND = 12, 1e-13


def stems(word: str) -> list[str]:
    """The stems that a word may give: its prefixes and, if not too long, itself."""
    out = [word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)]
    return [*out, word + _END] if len(word) <= WHOLE else out


def words_of(text: str) -> Counter:
    text = text.lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return Counter(_WORD.findall(text))
    return Counter(_LATIN_WORD.findall(text))


def association(n_toxic: int, n_clean: int) -> Column:
    """Likelihood-ratio statistic of a stem in ``toxic`` and ``clean`` examples of so many."""
    toxic, clean = F.col("toxic"), F.col("clean")
    seen, size = toxic + clean, n_toxic + n_clean

    def part(found: Column, expected: Column) -> Column:
        return F.when(found > 0, 2 * found * F.log(found / expected)).otherwise(0.0)

    return (part(toxic, seen * n_toxic / size) + part(clean, seen * n_clean / size)
            + part(n_toxic - toxic, (size - seen) * n_toxic / size)
            + part(n_clean - clean, (size - seen) * n_clean / size))


class Terms:
    """Stems with their statistic and weight, and the vectors of texts over them.

    Term 0 is the background.
    """

    def __init__(self, names: list[str], g2: np.ndarray, idf: np.ndarray):
        self.names, self.idf = names, idf
        self.g2 = g2
        self._at = {name: k + 1 for k, name in enumerate(names)}
        #: Only words that begin like a stem can have one.
        self._heads = {name.removesuffix(_END)[:SHORTEST] for name in names}
        self._known: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def term(self, word: str) -> int:
        """The stem of greatest statistic (ties: the longest), or the background."""
        found = self._known.get(word)
        if found is None:
            options = [t for t in map(self._at.get, stems(word)) if t]
            found = min(options, key=lambda t: (-self.g2[t - 1], t)) if options else 0
            if len(self._known) < REMEMBERED:
                self._known[word] = found
        return found

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms (rising) and weights of a text, at unit length; empty without a word."""
        words, heads, known = words_of(text), self._heads, self._known
        counts: dict[int, int] = {}
        for word in [w for w in words if w[:SHORTEST] in heads]:
            t = known.get(word)
            if t is None:
                t = self.term(word)
            if t:
                counts[t] = counts.get(t, 0) + words[word]
        rest = words.total() - sum(counts.values())
        if rest:
            counts[0] = rest
        terms = np.array(sorted(counts), np.int64)
        if not len(terms):
            return terms, np.empty(0)
        weight = np.sqrt([counts[t] for t in terms.tolist()])
        weight *= np.where(terms == 0, BACKGROUND, self.idf[terms - 1] if len(self.idf) else 1.0)
        return terms, weight / np.sqrt((weight ** 2).sum())


class Index:
    """Block-max inverted index over unit vectors; searches are exact."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n, self.n_blocks = len(vectors), -(-len(vectors) // BLOCK)
        place = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        terms = np.concatenate([np.empty(0, np.int64), *(t for t, _ in vectors)])
        weights = np.concatenate([np.empty(0), *(w for _, w in vectors)])
        order = np.lexsort((place, terms))
        self.place, self.weight = place[order], weights[order]
        cell = terms[order] * self.n_blocks + self.place // BLOCK
        #: Of every term and block: where its postings begin and end, and their greatest weight.
        cells = np.searchsorted(cell, np.arange(n_terms * self.n_blocks + 1))
        self.begin = cells[:-1].reshape(n_terms, self.n_blocks)
        self.end = cells[1:].reshape(n_terms, self.n_blocks)
        #: Of terms that many examples hold: their weight in every example.
        self.common = {}
        for t in np.flatnonzero(np.bincount(terms, minlength=n_terms) > self.n * COMMON).tolist():
            a, b = self.begin[t, 0], self.end[t, -1]
            self.common[t] = np.zeros(self.n)
            self.common[t][self.place[a:b]] = self.weight[a:b]
        self.greatest = np.zeros((n_terms, self.n_blocks))
        np.maximum.at(self.greatest.reshape(-1), cell, self.weight)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int,
               without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples of cosine above 0, nearest first.

        The blocks of highest bound are scored first; then, at once, those whose bound reaches
        the k-th best found there.
        """
        none = np.empty(0, np.int64), np.empty(0)
        if not len(terms) or not self.n:
            return none
        # Cosines are rounded, so that sums in another order tie; a bound is never the lower.
        bound = np.round(weights @ self.greatest[terms] + 2 * _ROUND, _PLACES)
        order = np.argsort(-bound, kind="stable")
        first = order[:FIRST_BLOCKS]
        places, cosines = self._best(none, first, terms, weights, k, without)
        rest = order[FIRST_BLOCKS:]
        least = 0.0
        if len(places) == k:
            least, last = cosines[-1], places[-1]
            above, tie = bound[rest] > least, (bound[rest] == least) & (rest * BLOCK < last)
            rest = rest[above | tie]
        if len(rest) > READ_THROUGH * self.n_blocks:
            return self._through(terms, weights, k, without, least)
        if len(rest):
            return self._best((places, cosines), rest, terms, weights, k, without)
        return places, cosines

    def _through(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int,
                 least: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best of all examples; ``least``: what the k-th best reaches at any rate."""
        sums = np.zeros(self.n)
        # An example stands once in a term's postings; sums run by rising term, as in _best.
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            if t in self.common:
                sums += w * self.common[t]
            else:
                a, b = self.begin[t, 0], self.end[t, -1]
                sums[self.place[a:b]] += w * self.weight[a:b]
        if without >= 0:
            sums[without] = 0.0
        places = np.flatnonzero(sums > max(0.0, least - 2 * 10.0 ** -_PLACES))
        cosines = np.round(sums[places], _PLACES)
        best = _first(places, cosines, k)
        best = best[cosines[best] > 0]
        return places[best], cosines[best]

    def _best(self, so_far: tuple, blocks: np.ndarray, terms: np.ndarray, weights: np.ndarray,
              k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of those found so far and the examples of the blocks."""
        cells = terms[:, None], blocks
        begin = self.begin[cells]
        many = self.end[cells] - begin
        flat = many.reshape(-1)
        total = int(flat.sum())
        at = np.arange(total) + np.repeat(begin.reshape(-1) - (np.cumsum(flat) - flat), flat)
        # Sums run by rising term, as the postings of a term follow those of the one before.
        sums = np.bincount(self.place[at], np.repeat(weights, many.sum(axis=1)) * self.weight[at],
                           minlength=self.n)
        if without >= 0:
            sums[without] = 0.0
        places = np.flatnonzero(sums)
        cosines = np.round(sums[places], _PLACES)
        near = _first(places, cosines, k)
        places = np.concatenate([so_far[0], places[near]])
        cosines = np.concatenate([so_far[1], cosines[near]])
        best = _first(places, cosines, k)
        best = best[cosines[best] > 0]
        return places[best], cosines[best]


def _first(places: np.ndarray, cosines: np.ndarray, k: int) -> np.ndarray:
    """Where the k best stand: by falling cosine, ties by rising place."""
    if len(places) <= k:
        return np.lexsort((places, -cosines))
    near = np.flatnonzero(cosines >= np.partition(cosines, len(places) - k)[len(places) - k])
    return near[np.lexsort((places[near], -cosines[near]))[:k]]


@dataclass
class Examples:
    """The labelled examples in index order, and the curve from votes to scores.

    ``share`` is the known share of label 1; ``weight`` how many labelled documents each example
    stands for.
    """

    terms: Terms
    index: Index
    ids: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray
    share: float
    slope: float = 0.0
    offset: float = 0.0

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """Share of label 1 among the neighbours by cosine, with the known share as prior."""
        w = cosines * self.weight[places]
        return float((w @ self.toxic[places] + PRIOR * self.share) / (w.sum() + PRIOR))

    def calibrated(self, vote: float) -> float:
        if self.share in (0.0, 1.0):
            return self.share
        return float(1 / (1 + np.exp(-(self.slope * vote + self.offset))))

    def assess(self, text: str, memo: dict | None = None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Score, and the places, cosines and own terms that speak for it."""
        terms, weights = self.terms.vector(text)
        key = (terms.tobytes(), weights.tobytes())
        if memo is not None and len(terms) <= 1 and key in memo:
            return (*memo[key], terms)
        places, cosines = self.index.search(terms, weights, NEIGHBOURS)
        found = self.calibrated(self.vote(places, cosines)), places, cosines
        if memo is not None and len(terms) <= 1:
            memo[key] = found  # one entry a term
        return (*found, terms)


def curve(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of greatest weighted likelihood (a little damped)."""
    x = np.stack([votes, np.ones(len(votes))], axis=1)
    theta = np.zeros(2)
    weight = weight / weight.sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (p - toxic)) + 1e-4 * theta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        theta = theta - step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return float(max(theta[0], 0.0)), float(theta[1])


def _chosen(docs: DataFrame, labels: DataFrame, toxic_docs: int, clean_docs: int) -> tuple[DataFrame, list]:
    """doc_id, toxic of the sampled labelled documents; (toxic, documents) of all labelled ones."""
    marks = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
             .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    with_text = docs.where("doc_id is not null and text is not null").select("doc_id").distinct()
    marks = stored(marks.join(with_text, "doc_id"), "toxic")
    counts = [(r.toxic, r["count"]) for r in marks.groupBy("toxic").count().collect()]
    parts = [marks.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
             for y, most in ((1, toxic_docs), (0, clean_docs))]
    return parts[0].unionByName(parts[1]), counts


def _stem_counts(sample: DataFrame) -> DataFrame:
    """stem, toxic, clean: the examples of either class that hold a stem."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches(frames, 64):
            seen = (Counter(), Counter())
            for text, y in zip(part["text"], part["toxic"], strict=True):
                seen[1 - y].update({s for w in words_of(text) for s in stems(w)})
            names = list(seen[0] | seen[1])
            yield pd.DataFrame({"stem": names, "toxic": [seen[0][s] for s in names],
                                "clean": [seen[1][s] for s in names]})

    return (sample.mapInPandas(run, "stem string, toxic long, clean long")
            .groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .where(F.col("toxic") >= LEAST_SEEN))


def learn(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS,
          clean_docs: int = CLEAN_DOCS) -> Examples:
    """Terms, index and curve from the labelled documents; only stems that tell and the examples'
    vectors reach the driver, both bounded."""
    ship(docs.sparkSession)
    chosen, counts = _chosen(docs, labels, toxic_docs, clean_docs)
    known = dict(counts)
    total = sum(known.values())
    share = known.get(1, 0) / total if total else 0.0
    sample = stored(docs.where("text is not null").select("doc_id", "text").join(
        F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
            F.min("text").alias("text"), F.first("toxic").alias("toxic")), "toxic")
    n_toxic, n_clean = (min(known.get(y, 0), most) for y, most in ((1, toxic_docs), (0, clean_docs)))
    if share in (0.0, 1.0):
        terms = Terms([], np.empty(0), np.empty(0))
        return Examples(terms, Index([], 1), np.empty(0), np.empty(0), np.empty(0), share)
    size = n_toxic + n_clean
    told = (_stem_counts(sample).where(F.col("toxic") * n_clean > F.col("clean") * n_toxic)
            .withColumn("g2", F.round(association(n_toxic, n_clean), 9)).where(F.col("g2") >= LEAST_G2)
            .orderBy(F.col("g2").desc(), F.length("stem").desc(), "stem").limit(MOST_STEMS).toPandas())
    idf = np.log((size + 1) / (told["toxic"] + told["clean"] + 1).to_numpy(float)) + 1
    terms = Terms(told["stem"].tolist(), told["g2"].to_numpy(float), idf)

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches(frames, 64):
            found = [terms.vector(t) for t in rows["text"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "toxic": rows["toxic"],
                                "terms": [t.tolist() for t, _ in found],
                                "weights": [w.tolist() for _, w in found]})

    ids = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInPandas(vectors, f"doc_id {ids}, toxic int, terms array<long>, "
                                       "weights array<double>").orderBy("doc_id").toPandas()
    found = [(np.array(t, np.int64), np.array(w, float))
             for t, w in zip(rows["terms"], rows["weights"], strict=True)]
    # Alike examples stand together: by their heaviest stem, then by its weight, then by id.
    heaviest, least = np.full(len(found), -1), np.zeros(len(found))
    for k, (t, w) in enumerate(found):
        if len(t):
            at = int(np.argmax(np.where(t > 0, w, -1.0)))
            heaviest[k], least[k] = t[at], -w[at]
    order = np.lexsort((least, heaviest))
    found = [found[k] for k in order]
    toxic = rows["toxic"].to_numpy(float)[order]
    weight = np.where(toxic > 0, known[1] / n_toxic, known[0] / n_clean)
    out = Examples(terms, Index(found, len(terms.names) + 1), rows["doc_id"].to_numpy()[order],
                   toxic, weight, share)
    votes = np.array([out.vote(*out.index.search(t, w, NEIGHBOURS, without=k))
                      for k, (t, w) in enumerate(found)])
    out.slope, out.offset = curve(votes, toxic, weight)
    return out


def score(docs: DataFrame, examples: Examples) -> DataFrame:
    """doc_id, held_out, score, predicted, stems (toxic stems of the text) and nearest (doc_id,
    cosine and label of the nearest examples) for every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(examples)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, memo = shared.value, {}
        for part in batches(frames, 256):
            rows = []
            for text in part["text"]:
                s, places, cosines, terms = known.assess(text, memo)
                rows.append((s, int(s >= THRESHOLD), [known.terms.names[t - 1] for t in terms if t],
                             [{"doc_id": known.ids[p], "cosine": c, "toxic": int(known.toxic[p])}
                              for p, c in zip(places[:EVIDENCE].tolist(), cosines[:EVIDENCE].tolist(),
                                              strict=True)]))
            out = pd.DataFrame(rows, columns=["score", "predicted", "stems", "nearest"])
            out.insert(0, "held_out", part["held_out"].to_numpy())
            out.insert(0, "doc_id", part["doc_id"].to_numpy())
            yield out

    ids = docs.schema["doc_id"].dataType.simpleString()
    rows = id_and_text(docs).withColumn("held_out", id_mod(F.col("doc_id"), FOLDS) == HELD_FOLD)
    return rows.mapInPandas(
        run, f"doc_id {ids}, held_out boolean, score double, predicted int, stems array<string>, "
             f"nearest array<struct<doc_id: {ids}, cosine: double, toxic: int>>")


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels outside the held-out fold, score every document."""
    seen = labels.where(id_mod(F.col("doc_id"), FOLDS) != HELD_FOLD)
    return score(docs, learn(docs, seen)).select(
        "doc_id", "held_out", "score", "predicted", F.array_join("stems", " ").alias("stems"))
