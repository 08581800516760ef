"""Nearest neighbours by collision counting over single-projection sorted arrays.

Every vector is indexed in one block: for each of ``PROJECTIONS`` random directions the block
holds its vectors' projections as a sorted array.  A query opens a window around its own
projection in every array; virtual rehashing widens all windows step by step (each step visits
only the new rings) and counts, for each vector, the arrays in which it fell into the window.
A vector whose count reaches ``THRESHOLD`` is verified by its exact inner product.  Widening
ends when ``k`` plus a ``VERIFIED`` share of the block has been verified.  The steps have fixed
widths and a wider window loses no vector, so a query may begin at the step where the one before
ended and go in or out from there: it ends at the same step with the same vectors.

Largest inner product becomes smallest distance by one more coordinate that lifts all vectors
of a block to the same norm.  Blocks and query blocks have bounded sizes; a pair of blocks is
one task's work, its answer is at most ``k`` rows a query, and the blocks' answers are merged
by rank.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part,
nor do rows with a null id or another length than most of the queries' block partners; of
repeated rows of an id one is kept (the smallest by bytes); equal vectors are indexed once and
tie by the smaller id; with fewer than ``k`` candidates all are returned; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakestar.llm.common import ship, stored

K, QUERY_EVERY = 20, 20
#: Random directions, and the number of windows a vector must share with the query.
PROJECTIONS, THRESHOLD = 24, 18
#: Share of a block's vectors to verify before widening ends; widening factor of a step.
VERIFIED, WIDEN = 0.5, 1.35
#: Vectors in an index block, queries in a query block.
BLOCK, QUERY_BLOCK = 16384, 2048


def directions(dims: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, PROJECTIONS))


class Block:
    """Sorted projections of one block's distinct vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int = K):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        first, group = np.unique(vectors, axis=0, return_index=True, return_inverse=True)[1:]
        self.vectors = vectors[first]
        # Of equal vectors only the k + 1 smallest ids can be among k answers.
        by_group = np.argsort(group.ravel(), kind="stable")
        ends = np.cumsum(np.bincount(group.ravel(), minlength=len(first)))
        starts = np.concatenate([[0], ends[:-1]])
        self.members = [ids[by_group[a:min(b, a + k + 1)]] for a, b in zip(starts, ends, strict=True)]
        norms = np.linalg.norm(self.vectors, axis=1)
        self.top = float(norms.max())
        lifted = np.column_stack([self.vectors, np.sqrt(np.maximum(self.top ** 2 - norms ** 2, 0))])
        self.directions = directions(lifted.shape[1])
        projected = lifted @ self.directions
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.values = np.sort(projected, axis=0).T.copy()
        self.widths = [float(np.median(np.abs(projected - np.median(projected, axis=0)))) / 2 or 1.0]
        #: Where the last query's widening ended.
        self.step = 0

    def _window(self, centres: np.ndarray, step: int) -> tuple[list[int], list[int]]:
        """Of every array, where the window of a step begins and ends."""
        while len(self.widths) <= step:
            self.widths.append(self.widths[-1] * WIDEN)
        width = self.widths[step]
        return ([int(v.searchsorted(c, "left")) for v, c in zip(self.values, centres - width, strict=True)],
                [int(v.searchsorted(c, "right")) for v, c in zip(self.values, centres + width, strict=True)])

    def _counts(self, low: list[int], high: list[int]) -> np.ndarray:
        """Of every vector, the arrays in which it is in the window."""
        n = len(self.vectors)
        if 2 * (sum(high) - sum(low)) <= len(self.order) * n:
            inside = [o[a:b] for o, a, b in zip(self.order, low, high, strict=True)]
            return np.bincount(np.concatenate(inside), minlength=n)
        outside = [part for o, a, b in zip(self.order, low, high, strict=True) for part in (o[:a], o[b:])]
        return len(self.order) - np.bincount(np.concatenate(outside), minlength=n)

    def _rings(self, outer: tuple, inner: tuple) -> np.ndarray:
        """Of every vector, the arrays in which it is in the outer window but not in the inner."""
        rings = [part for o, a, b, c, d in zip(self.order, *outer, *inner, strict=True)
                 for part in (o[a:c], o[d:b])]
        return np.bincount(np.concatenate(rings), minlength=len(self.vectors))

    def candidates(self, query: np.ndarray, wanted: int) -> np.ndarray:
        """Vectors past the collision threshold once ``wanted`` of them have been reached."""
        n = len(self.vectors)
        if n <= wanted:
            return np.arange(n)
        scaled = np.append(query * (self.top / np.linalg.norm(query)), 0.0)
        centres = scaled @ self.directions
        step = self.step
        window = self._window(centres, step)
        counts = self._counts(*window)
        found = np.flatnonzero(counts >= THRESHOLD)
        while len(found) >= wanted and step:
            inner = self._window(centres, step - 1)
            counts -= self._rings(window, inner)
            fewer = np.flatnonzero(counts >= THRESHOLD)
            if len(fewer) < wanted:
                break
            step, window, found = step - 1, inner, fewer
        while len(found) < wanted and (any(window[0]) or min(window[1]) < n):
            outer = self._window(centres, step + 1)
            counts += self._rings(outer, window)
            step, window, found = step + 1, outer, np.flatnonzero(counts >= THRESHOLD)
        self.step = step
        return found

    def search(self, query_id: int, query: np.ndarray, k: int, share: float) -> list[tuple]:
        """(id, inner product) of the k nearest verified members, ties to the smaller id."""
        n = len(self.vectors)
        found = self.candidates(query, min(n, k + 1 + math.ceil(share * n)))
        if len(found) > k + 1:
            # A matrix product may round by a row's place: it only narrows the choice.
            near = (self.vectors @ query)[found]
            least = np.partition(near, len(near) - k - 1)[len(near) - k - 1]
            found = found[near >= least - 1e-9 * (1 + abs(least))]
        scores = (self.vectors[found] * query).sum(axis=1)
        pairs = [(-s, i) for f, s in zip(found, scores, strict=True)
                 for i in self.members[f] if i != query_id]
        return [(i, -s) for s, i in sorted(pairs)[:k]]


def _packed(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector as float64 bytes, one row an id, usable vectors only."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, e in zip(frame["vec_id"], frame["embedding"], strict=True):
                v = None if e is None else np.array(e, np.float64)
                if v is not None and v.ndim == 1 and len(v) and np.isfinite(v).all() and v.any():
                    rows.append((i, v.tobytes()))
            yield pd.DataFrame(rows, columns=["vec_id", "v"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return (rows.where("vec_id is not null and embedding is not null")
            .mapInPandas(pack, "vec_id long, v binary").groupBy("vec_id").agg(F.min("v").alias("v")))


def nearest(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY,
            share: float = VERIFIED) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest of each query.

    Queries are the vectors whose id is divisible by ``every``; candidates are all others.
    """
    spark = vectors.sparkSession
    ship(spark)
    packed = stored(_packed(vectors), "ann")
    sizes = packed.groupBy(F.length("v").alias("bytes")).agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("queries")).collect()
    # A block holds vectors of one length; in a sound table there is one length.
    n_blocks = max([math.ceil(r["n"] / BLOCK) for r in sizes], default=1)
    n_query = max([math.ceil(r["queries"] / QUERY_BLOCK) for r in sizes], default=1) or 1
    rows = packed.withColumn("bytes", F.length("v"))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_query)).cast("int")
    index = rows.withColumn("block", block).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("part", part).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            held = Block(left["vec_id"].to_numpy(), _matrix(left["v"]), k)
            for q, v in zip(right["vec_id"], _matrix(right["v"]), strict=True):
                out += [(q, i, s) for i, s in held.search(q, v, k, share)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = (index.groupBy("bytes", "block", "part")
             .cogroup(queries.groupBy("bytes", "block", "part"))
             .applyInPandas(search, "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), np.float64).reshape(len(column), -1)
