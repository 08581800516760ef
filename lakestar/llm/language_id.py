"""Language identification with segmentation-marginalised unigram models.

Every language has a probability for each piece of one fixed public vocabulary.  The
likelihood of a word is the sum over all its segmentations into pieces, computed by a forward
pass over the word's positions; a text's likelihood is the product over its words.  Piece
probabilities are fitted by expectation-maximisation over the word counts of a bounded sample
of labelled documents: each round is one Spark job that runs forward and backward passes over
distinct words and sums the expected piece counts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a null ``lang``
is never learned from; with no labelled row every document is ``und``; repeated rows are each
predicted; ties between languages go to the alphabetically first; words are runs of letters,
lower-cased, and runs over 40 letters are cut into pieces of 40; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestar.llm.common import batches, id_and_text, id_mod, ship, stored

UND = "und"
FOLDS, HELD_FOLD = 5, 0
#: Learning: at most so many labelled documents (lowest id hashes), so many rounds.
SAMPLE_DOCS, ROUNDS = 3000, 3
#: Added to a piece's expected count; probability of a character that is no piece.
SMOOTHING, UNKNOWN = 0.05, 1e-7
#: Factor of each letter in the sums, a power of two, so that it changes no digit: with words of
#: 41 letters no sum leaves the range of doubles while pieces have probabilities above 1e-13.
SCALE = 2.0 ** 20
LONGEST_WORD = 40
#: Words whose likelihoods a worker keeps (speed only, not results).
MEMO = 400_000

_WORDS = re.compile(r"[^\W\d_]+").findall
_START = "▁"
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, the longest cut; empty if the text has no letter."""
    words = _WORDS(text.lower())
    if not any(any(map(str.isalpha, w)) for w in words):
        return []
    if len(text) > LONGEST_WORD and max(map(len, words)) > LONGEST_WORD:
        words = [w[i:i + LONGEST_WORD] for w in words for i in range(0, len(w), LONGEST_WORD)]
    return words


def _hash(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(len(codes), np.uint64)
    for column in codes.T:
        h = (h + column + np.uint64(1)) * _MULT
    return h


def _codes(words: list[str], length: int) -> np.ndarray:
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(words), length).astype(np.uint64)


class Pieces:
    """A fixed vocabulary, looked up by the hashes of character spans."""

    def __init__(self, pieces: list[str]):
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            by_length.setdefault(len(piece), []).append(i)
        self.longest = max(by_length)
        ids = np.concatenate([np.array(v) for v in by_length.values()])
        hashes = np.concatenate([_hash(_codes([pieces[i] for i in v], n))
                                 for n, v in by_length.items()])
        order = np.argsort(hashes, kind="stable")
        self._hashes, self._ids = hashes[order], ids[order]
        self.size = len(pieces)

    @classmethod
    def load(cls, path: str) -> Pieces:
        """The ordinary pieces of a sentencepiece model, lower-cased duplicates dropped."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
                if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        return cls(sorted({p for p in kept if p == p.lower() and len(p) <= 16}))

    def lattice(self, words: list[str], length: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """For words of one length: (start, end, piece of each word or ``size``), by end."""
        codes = _codes(words, length)
        spans: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(length + 1)]
        for i in range(length):
            h = np.zeros(len(words), np.uint64)
            for j in range(i + 1, min(length, i + self.longest) + 1):
                h = (h + codes[:, j - 1] + np.uint64(1)) * _MULT
                at = np.minimum(np.searchsorted(self._hashes, h), len(self._hashes) - 1)
                found = self._hashes[at] == h
                if j == i + 1 or found.any():
                    spans[j].append((i, np.where(found, self._ids[at], self.size)))
        for j, entries in enumerate(spans):
            for i, ids in entries:
                yield i, j, ids


@dataclass
class Model:
    """Languages, log priors and piece probabilities [pieces + 1, languages]."""

    languages: list[str]
    priors: np.ndarray
    probs: np.ndarray

    def step(self, i: int, j: int, ids: np.ndarray) -> np.ndarray:
        """Probability of the span from i to j as one piece, times ``SCALE`` for each letter."""
        p = self.probs[ids]
        if j == i + 1:
            p = np.where((ids == len(self.probs) - 1)[:, None], UNKNOWN, p)
        return p * SCALE ** (j - i)

    def forward(self, pieces: Pieces, words: list[str], length: int):
        """Forward sums [position, word, language], times ``SCALE`` for each letter passed, and
        the lattice they ran over."""
        sums = np.zeros((length + 1, len(words), len(self.languages)))
        sums[0] = 1.0
        lattice = list(pieces.lattice(words, length))
        for i, j, ids in lattice:
            sums[j] += sums[i] * self.step(i, j, ids)
        return sums, lattice

    def log_likelihoods(self, pieces: Pieces, words: list[str]) -> np.ndarray:
        """log P(word | language), marginalised over segmentations, for distinct words."""
        out = np.empty((len(words), len(self.languages)))
        for length, at in _by_length(words).items():
            for block in range(0, len(at), 4096):
                rows = at[block:block + 4096]
                sums, _ = self.forward(pieces, [_START + words[r] for r in rows], length + 1)
                out[rows] = np.log(sums[-1]) - (length + 1) * np.log(SCALE)
        return out

    def expected_counts(self, pieces: Pieces, words: list[str], n: np.ndarray) -> np.ndarray:
        """Expected uses of each piece [pieces + 1, languages]; n: counts [word, language]."""
        out = np.zeros_like(self.probs)
        for length, at in _by_length(words).items():
            for block in range(0, len(at), 4096):
                rows = at[block:block + 4096]
                sums, lattice = self.forward(pieces, [_START + words[r] for r in rows], length + 1)
                back = np.zeros_like(sums)
                back[-1] = n[rows] / sums[-1]
                for i, j, ids in reversed(lattice):
                    step = self.step(i, j, ids)
                    back[i] += back[j] * step
                    used = sums[i] * step * back[j]
                    for k in range(len(self.languages)):
                        out[:, k] += np.bincount(ids, used[:, k], len(out))
        return out


def _by_length(words: list[str]) -> dict[int, np.ndarray]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}


_PIECES: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces.load(path)
    return _PIECES[path]


def learn(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS,
          rounds: int = ROUNDS) -> Model | None:
    """Fit the piece probabilities on at most ``sample_docs`` labelled documents.

    ``docs`` has doc_id, text and lang; the sample is the rows with the lowest id hashes.
    The driver sees (pieces x languages) sums only; word counts stay distributed.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where("lang is not null and text is not null and doc_id is not null")
    # Only ids are ranked, so the sort never carries texts.
    ids = (rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
           .distinct())
    sample = rows.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in batches([frame], 512):
                n: Counter = Counter()
                for text, lang in zip(part["text"], part["lang"], strict=True):
                    words = words_of(text)
                    if words:
                        n.update((lang, w) for w in words)
                        n[lang, ""] += 1  # a document
                yield pd.DataFrame([(a, w, k) for (a, w), k in n.items()],
                                   columns=["lang", "word", "n"])

    counted = stored(sample.mapInPandas(count, "lang string, word string, n long")
                     .groupBy("word", "lang").agg(F.sum("n").alias("n"))
                     .groupBy("word").agg(F.map_from_entries(
                         F.collect_list(F.struct("lang", "n"))).alias("n")), "langid")
    docs_by_lang = counted.where("word = ''").select(F.explode("n")).collect()
    if not docs_by_lang:
        return None
    languages = sorted(r[0] for r in docs_by_lang)
    known = dict(map(tuple, docs_by_lang))
    share = np.array([known[a] for a in languages], float)
    pieces = _pieces(path)
    model = Model(languages, np.log(share / share.sum()),
                  np.full((pieces.size + 1, len(languages)), 1.0 / pieces.size))
    model.probs[-1] = 0.0
    # Few bytes but costly rows: spread them over all cores instead of by file size.
    words = counted.where("word <> ''").repartition(
        max(8, spark.sparkContext.defaultParallelism), "word")
    for _ in range(rounds):
        model = _round(words, path, model)
    return model


def _round(words: DataFrame, path: str, model: Model) -> Model:
    """One expectation-maximisation round over the distinct words."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def expect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, now = _pieces(path), shared.value
        total = np.zeros_like(now.probs)
        for frame in frames:
            n = np.array([[m.get(a, 0) for a in now.languages] for m in map(dict, frame["n"])],
                         float).reshape(len(frame), len(now.languages))
            total += now.expected_counts(pieces, list(frame["word"]), n)
        piece, lang = np.nonzero(total)
        yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

    summed = (words.mapInPandas(expect, "piece long, lang long, n double")
              .groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros_like(model.probs)
    for piece, lang, n in summed:
        counts[piece, lang] = round(n, 6)  # sums arrive in any order; keep the model stable
    counts[-1] = 0.0
    counts[:-1] += SMOOTHING
    shared.unpersist()
    return Model(model.languages, model.priors, counts / counts.sum(axis=0))


class Scorer:
    """Scores texts in a worker; likelihoods of seen words are kept."""

    def __init__(self, pieces: Pieces, model: Model):
        self.pieces, self.model = pieces, model
        self.rows: dict[str, int] = {}
        self.logs = np.empty((0, len(model.languages)))

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Predicted language and its posterior, for each text."""
        if len(self.rows) > MEMO:
            self.rows, self.logs = {}, self.logs[:0]
        split = [words_of(t) for t in texts]
        new = list({w for words in split for w in words if w not in self.rows})
        if new:
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)),
                                 strict=True))
            self.logs = np.concatenate([self.logs,
                                        self.model.log_likelihoods(self.pieces, new)])
        langs, scores = [], []
        for words in split:
            if not words:
                langs.append(UND)
                scores.append(0.0)
                continue
            at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
            total = self.logs[at].sum(axis=0) + self.model.priors
            odds = np.exp(total - total.max())
            best = int(odds.argmax())
            langs.append(self.model.languages[best])
            scores.append(float(odds[best] / odds.sum()))
        return langs, scores


def predict(docs: DataFrame, path: str, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; a narrow pass over whole texts."""
    ship(docs.sparkSession)
    ids = docs.schema["doc_id"].dataType.simpleString()
    rows = id_and_text(docs).withColumn("held_out", id_mod(F.col("doc_id"), FOLDS) == HELD_FOLD)
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UND).alias("lang_pred"),
                           F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(_pieces(path), shared.value)
        for part in batches(frames, 256):
            langs, scores = scorer.score(list(part["text"]))
            yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"],
                                "lang_pred": langs, "score": scores})

    return rows.mapInPandas(
        score, f"doc_id {ids}, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame, path: str, model: Model | None, least: float) -> DataFrame:
    """The rows of ``docs`` (all columns) whose predicted language has a posterior >= ``least``.

    Rows are filtered where they are read: nothing is joined or shuffled.
    """
    ship(docs.sparkSession)
    if model is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(_pieces(path), shared.value)
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.slice(at, 256)
                _, scores = scorer.score([t or "" for t in part.column("text").to_pylist()])
                yield part.filter(pa.array([s > 0 and s >= least for s in scores], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def identify(docs: DataFrame, path: str) -> DataFrame:
    """Learn from the rows outside the held-out fold, predict every row."""
    return predict(docs, path, learn(
        docs.where(id_mod(F.col("doc_id"), FOLDS) != HELD_FOLD), path))
