"""Mixing documents to domain targets by soft membership (DataFrame functions only).

A classifier learned from a labelled table gives every document a posterior over domains
(naive Bayes over hashed words, each document's evidence counted as at most ``EVIDENCE``
words).  Document rates r >= 0 then minimise

    1/2 * sum_d (T_d(r) - b_d)^2 / N_d,   T_d(r) = sum_i t_i p_id r_i,

with t_i the document's tokens, p_id its posterior, N_d the domain's expected tokens at rate 1
and b_d its target.  In the token-weighted metric the step of length 1 is the inverse of the
largest curvature, and the projected gradient step reads

    r_i <- max(0, r_i - sum_d p_id (T_d - b_d) / N_d):

a document's rate is a fold over the short history of residuals; one round is one aggregation
of D sums over the narrow table of posteriors.  Every ``WRITTEN`` rounds the rates so far are
written beside the posteriors, so that a round folds a few steps only, however many came before.

Defined cases: null and empty texts have 0 tokens, the prior as posterior and a rate like any
other row; rows without a label are not learned from; without any labelled row there is one
class per target with equal posteriors; a domain without documents keeps its residual; repeated
rows are rows of their own; a null id is carried through; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestar.llm.common import stored

#: Word buckets, pseudo-count of a bucket, words that a document's evidence counts as at most.
BUCKETS, SMOOTHING, EVIDENCE = 2048, 0.5, 60.0
#: Learning: at most so many labelled documents (lowest id hashes).
SAMPLE_DOCS = 4000
#: Rounds at most; the residual (share of all tokens) that ends them, and the change of the
#: domains' sums in a round (share of all tokens) that does.
ROUNDS, TOLERANCE, STATIONARY = 60, 5e-4, 1e-4
#: Rounds after which the rates so far are written.
WRITTEN = 8
#: Target share of tokens for each domain of the labelled table.
TARGETS = {"high": 0.92, "low": 0.06, "toxic": 0.02}


def domain(quality: Column, toxic: Column) -> Column:
    """The domain of a labelled document; null where the labels do not tell."""
    return (F.when(toxic == 1, "toxic").when(quality == 1, "high").when(quality == 0, "low"))


def words(text: Column) -> Column:
    """The text's runs of non-space characters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), 0)


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


@dataclass
class Memberships:
    """Domain names, log priors, and each bucket's log probability in each domain."""

    domains: list[str]
    priors: list[float]
    weights: list[list[float]]

    def evidence(self, text: Column) -> Column:
        """struct<n, w0, w1, ...>: words of a text and their summed weights."""
        n = len(self.domains)
        table = F.from_json(F.lit(json.dumps(
            [{f"w{d}": round(w[d], 6) for d in range(n)} for w in self.weights])),
            "array<struct<" + ",".join(f"w{d}:double" for d in range(n)) + ">>")
        zero = F.struct(F.lit(0).alias("n"), *[F.lit(0.0).alias(f"w{d}") for d in range(n)])

        def step(state: Column, word: Column) -> Column:
            at = F.get(table, bucket(word))
            return F.struct((state["n"] + 1).alias("n"), *[
                (state[f"w{d}"] + at[f"w{d}"]).alias(f"w{d}") for d in range(n)])

        return F.aggregate(words(text), zero, step)

    def posteriors(self, rows: DataFrame, text: Column) -> DataFrame:
        """row (all columns of ``rows`` as one struct), tokens and p (posterior array)."""
        rows = rows.select(F.struct("*").alias("row"), self.evidence(text).alias("s"))
        scale = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(F.col("s.n"), F.lit(1)))
        logits = [F.lit(self.priors[d]) + scale * F.col(f"s.w{d}")
                  for d in range(len(self.domains))]
        rows = rows.select("row", F.col("s.n").cast("long").alias("tokens"),
                           F.array(*logits).alias("z"))
        rows = rows.select("row", "tokens", F.transform(
            "z", lambda z: F.exp(z - F.array_max("z"))).alias("e"))
        total = F.aggregate("e", F.lit(0.0), lambda a, b: a + b)
        return rows.select("row", "tokens", F.transform("e", lambda e: e / total).alias("p"))


def learn(docs: DataFrame, labels: DataFrame, domains: list[str],
          sample_docs: int = SAMPLE_DOCS) -> Memberships:
    """Count hashed words by domain over a bounded sample of labelled documents."""
    marked = (labels.select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("domain"))
              .where("doc_id is not null").where(F.col("domain").isin(domains))
              .groupBy("doc_id").agg(F.min("domain").alias("domain")))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    counted = (rows.select("domain", F.explode(words(F.col("text"))).alias("word"))
               .groupBy("domain", bucket(F.col("word")).alias("bucket"))
               .count().collect())  # at most domains x buckets rows
    share = {r["domain"]: r["count"] for r in chosen.groupBy("domain").count().collect()}
    total = sum(share.values())
    counts = {(r["domain"], r["bucket"]): r["count"] for r in counted}
    sums = {d: sum(counts.get((d, b), 0) for b in range(BUCKETS)) for d in domains}
    weights = [[math.log((counts.get((d, b), 0) + SMOOTHING)
                         / (sums[d] + SMOOTHING * BUCKETS)) for d in domains]
               for b in range(BUCKETS)]
    priors = [math.log((share.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    return Memberships(list(domains), priors, weights)


def rate(p: Column, history: list[list[float]], start: Column | None = None) -> Column:
    """A document's rate: the projected steps of rounds, folded over its posterior.

    ``start``: its rate before them (default: before all, 1).
    """
    start = F.lit(1.0) if start is None else start
    if not history:
        return start
    n = len(history[0])
    steps = F.from_json(F.lit(json.dumps(history)), "array<array<double>>")

    def step(r: Column, g: Column) -> Column:
        move = sum((p[d] * g[d] for d in range(1, n)), p[0] * g[0])
        return F.greatest(F.lit(0.0), r - move)

    return F.aggregate(steps, start, step)


@dataclass
class Mix:
    """Rows with their posteriors (a written table), and the steps that fix every rate."""

    domains: list[str]
    rows: DataFrame
    history: list[list[float]]
    targets: list[float]
    reached: list[float]

    def residuals(self) -> list[float]:
        """Reached minus target sum of each domain, as a share of all tokens."""
        total = sum(self.targets)
        return [(a - b) / total if total else 0.0
                for a, b in zip(self.reached, self.targets, strict=True)]

    def rated(self) -> DataFrame:
        """row, tokens, p and rate."""
        return self.rows.withColumn("rate", rate(F.col("p"), self.history))


def solve(memberships: DataFrame, shares: list[float], rounds: int = ROUNDS,
          tolerance: float = TOLERANCE, stationary: float = STATIONARY, written: int = WRITTEN
          ) -> tuple[list[list[float]], list[float], list[float]]:
    """Projected-gradient rounds over (tokens, p): history of steps, targets, reached sums.

    The rounds end when the targets are met, when a round hardly moves a sum, or after
    ``rounds``.  Targets that overlapping posteriors put out of reach are approached ever more
    slowly; what is left of the gap is the residual.  After every ``written`` rounds the rates so
    far replace the steps that led to them (the same sums: a fold may stop and go on anywhere).
    """
    n = len(shares)
    held, done = memberships.select("tokens", "p", F.lit(1.0).alias("r")), 0

    def sums(r: Column) -> list[float]:
        row = held.agg(*[
            F.coalesce(F.sum(F.col("tokens") * F.col("p")[d] * r), F.lit(0.0)).alias(f"s{d}")
            for d in range(n)]).first()
        return [row[d] for d in range(n)]

    natural = sums(F.lit(1.0))
    total = sum(natural)
    targets = [s / sum(shares) * total for s in shares]
    history: list[list[float]] = []
    reached, moved = natural, math.inf
    while total and len(history) < rounds:
        gaps = [a - b for a, b in zip(reached, targets, strict=True)]
        if max(map(abs, gaps)) <= tolerance * total or moved <= stationary * total:
            break
        history.append([g / m if m > 0 else 0.0 for g, m in zip(gaps, natural, strict=True)])
        if len(history) - done == written:
            held = stored(held.select("tokens", "p", rate(F.col("p"), history[done:],
                                                          F.col("r")).alias("r")), "soft_mix")
            done = len(history)
        before, reached = reached, sums(rate(F.col("p"), history[done:], F.col("r")))
        moved = max(abs(a - b) for a, b in zip(reached, before, strict=True))
    return history, targets, reached


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None,
        keep: list[str] | None = None) -> Mix:
    """Learn the classifier, write rows (columns ``keep``) and posteriors, run the rounds.

    A round reads the token and posterior columns of that table alone.
    """
    targets = targets or TARGETS
    members = learn(docs, labels, list(targets))
    keep = keep or docs.columns
    rows = members.posteriors(docs, F.col("text"))
    rows = stored(rows.select(F.struct(*[F.col("row")[c].alias(c) for c in keep]).alias("row"),
                              "tokens", "p"), "soft_mix")
    return Mix(list(targets), rows, *solve(rows, list(targets.values())))


def mix_rates(docs: DataFrame, labels: DataFrame,
              targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, one p_<domain> each, rate, and one residual_<domain> each (the same in
    all rows: reached minus target tokens, as a share of all), for every row of ``docs``."""
    mix = fit(docs, labels, targets, ["doc_id"])
    return mix.rated().select(
        "row.doc_id", F.col("tokens").alias("n_tokens"),
        *[F.col("p")[d].alias(f"p_{name}") for d, name in enumerate(mix.domains)], "rate",
        *[F.lit(gap).alias(f"residual_{name}")
          for name, gap in zip(mix.domains, mix.residuals(), strict=True)])


def mixed(docs: DataFrame, labels: DataFrame,
          targets: dict[str, float] | None = None) -> DataFrame:
    """The mixed corpus: each row as often as its rate says, the fraction by an id hash.

    Keeps the columns of ``docs``; texts are written beside their posteriors, not joined.
    """
    rows = fit(docs, labels, targets).rated()
    chance = F.pmod(F.xxhash64("row.doc_id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")
    return (rows.select("row", copies.cast("int").alias("copies")).where("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*"))
