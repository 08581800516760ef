"""Quality scores from a factorisation machine over hashed words and text statistics.

Features of a text: relative frequencies of its words hashed into ``BUCKETS`` (square-rooted
and scaled to unit length), structure statistics (line, case, punctuation, repetition and
word-length figures) and its length as metadata.  The score is the logistic of

    w0 + x.w + 1/2 * sum_f ((x.V_f)^2 - (x^2).(V_f^2)),

so the pairwise interactions cost time linear in the features.  The machine is fitted on a
bounded sample of labelled rows; every row of the table is then scored in one narrow pass.

Defined cases: null texts count as empty; empty texts get the score of an all-zero word part;
rows without a label or with a null id are not learned from; several labels of one id count as
their mean; without both classes the score is the known share of label 1 (1 without labels);
repeated rows are each scored; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestar.llm.common import batches, id_and_text, id_mod, ship, word_hashes

FOLDS, HELD_FOLD = 4, 2
THRESHOLD = 0.7
BUCKETS, RANK = 512, 8
#: Learning: at most so many labelled documents (lowest id hashes), so many passes.
SAMPLE_DOCS, PASSES, BATCH, RATE, DECAY = 6000, 30, 128, 0.01, 1e-4

STATS = ("upper", "punct", "digit", "space", "symbol_runs", "short_lines", "repeat_words",
         "repeat_lines", "distinct_words", "top_word", "word_length", "pipes", "line_length",
         "n_words", "n_chars")
_ODD_RUN = re.compile(r"[^\w\s]{2,}")
_UPPER = re.compile(r"[A-Z]")
_PUNCT = re.compile(r"[^\w\s]")
_DIGIT = re.compile(r"\d")


def features(text: str) -> np.ndarray:
    """The feature vector of a whole text: BUCKETS word features, then the statistics."""
    x = np.zeros(BUCKETS + len(STATS))
    hashes = word_hashes(text)
    n, chars = len(hashes), len(text)
    if chars == 0:
        return x
    lines = [s for s in (line.strip() for line in text.split("\n")) if s]
    distinct = top = repeats = 0.0
    if n:
        counts = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % BUCKETS,
                             minlength=BUCKETS)
        root = np.sqrt(counts)
        x[:BUCKETS] = root / np.linalg.norm(root)
        each = np.unique(hashes, return_counts=True)[1]
        distinct, top = len(each) / n, each.max() / n
        repeats = float((hashes[1:] == hashes[:-1]).mean()) if n > 1 else 0.0
    count = lambda pattern: sum(1 for _ in pattern.finditer(text))
    punct = count(_PUNCT)
    x[BUCKETS:] = (
        count(_UPPER) / chars * 4, punct / chars * 4, count(_DIGIT) / chars * 4,
        sum(map(len, text.split())) / chars, count(_ODD_RUN) / (n + 1) * 4,
        sum(len(s) < 20 for s in lines) / (len(lines) + 1), repeats * 4,
        1 - len(set(lines)) / len(lines) if lines else 0.0, distinct, top * 4,
        (chars - punct) / (n + 1) / 10, text.count("|") / (n + 1) * 4,
        np.log1p(chars / (len(lines) + 1)) / 8, np.log1p(n) / 10, np.log1p(chars) / 12)
    return x


@dataclass
class Machine:
    """Bias, linear weights and factors; mean and scale standardise the statistics."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Sum-of-squares identity: linear in the number of features."""
        x = (x - self.mean) / self.scale
        pairs = (x @ self.v) ** 2 - (x ** 2) @ (self.v ** 2)
        return self.w0 + x @ self.w + 0.5 * pairs.sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Machine:
    """Logistic loss, Adam steps over shuffled mini-batches, decay on weights and factors."""
    rng = np.random.default_rng(seed)
    dims = x.shape[1]
    mean, scale = np.zeros(dims), np.ones(dims)
    if len(x):
        mean[BUCKETS:], scale[BUCKETS:] = x[:, BUCKETS:].mean(axis=0), x[:, BUCKETS:].std(axis=0) + 0.05
    share = float(y.mean()) if len(y) else 1.0
    if len(y) == 0 or share in (0.0, 1.0):
        bias = 30.0 if share == 1.0 else -30.0
        return Machine(bias, np.zeros(dims), np.zeros((dims, RANK)), mean, scale)
    z = (x - mean) / scale
    theta = [np.array([np.log(share / (1 - share))]), np.zeros(dims), rng.normal(0, 0.02, (dims, RANK))]
    first = [np.zeros_like(t) for t in theta]
    second = [np.zeros_like(t) for t in theta]
    step = 0
    for _ in range(PASSES):
        order = rng.permutation(len(z))
        for at in range(0, len(z), BATCH):
            rows = order[at:at + BATCH]
            b, xb = y[rows], z[rows]
            inner, square = xb @ theta[2], xb ** 2
            logit = theta[0][0] + xb @ theta[1] + 0.5 * (
                inner ** 2 - square @ theta[2] ** 2).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - b) / len(rows)
            grads = [np.array([g.sum()]), xb.T @ g + DECAY * theta[1],
                     xb.T @ (g[:, None] * inner) - theta[2] * (square.T @ g)[:, None]
                     + DECAY * theta[2]]
            step += 1
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad ** 2
                theta[k] = theta[k] - RATE * (first[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return Machine(float(theta[0][0]), theta[1], theta[2], mean, scale)


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Machine:
    """Fit on at most ``sample_docs`` labelled rows; only their features reach the driver.

    The bound holds for ids; of repeated rows of one id the learner takes one.
    """
    spark = docs.sparkSession
    ship(spark)
    marks = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
             .agg(F.avg("quality").alias("y")))
    # Labels of documents that exist, lowest id hashes; a sort of ids only.
    chosen = (marks.join(docs.where("doc_id is not null").select("doc_id").distinct(), "doc_id")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))
    rows = id_and_text(docs).join(F.broadcast(chosen), "doc_id")

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches(frames, 256):
            yield pd.DataFrame({"doc_id": part["doc_id"], "y": part["y"],
                                "x": [features(t).astype(np.float32).tobytes()
                                      for t in part["text"]]})

    ids = docs.schema["doc_id"].dataType.simpleString()
    sample = (rows.mapInPandas(vectors, f"doc_id {ids}, y double, x binary")
              .groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
              .orderBy("doc_id").toPandas())
    dims = BUCKETS + len(STATS)
    x = np.frombuffer(b"".join(map(bytes, sample["x"])), np.float32).reshape(-1, dims)
    return fit(x.astype(float), sample["y"].to_numpy(float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches(frames, 256):
            x = np.array([features(t) for t in part["text"]]).reshape(len(part), -1)
            s = shared.value.scores(x) if len(part) else np.empty(0)
            yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"],
                                "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)})

    ids = docs.schema["doc_id"].dataType.simpleString()
    rows = id_and_text(docs).withColumn("held_out", id_mod(F.col("doc_id"), FOLDS) == HELD_FOLD)
    return rows.mapInPandas(
        run, f"doc_id {ids}, held_out boolean, score double, predicted int")


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels outside the held-out fold, score every document."""
    seen = labels.where(id_mod(F.col("doc_id"), FOLDS) != HELD_FOLD)
    return score(docs, learn(docs, seen))
