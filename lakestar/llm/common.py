"""Helpers shared by the corpus operators: table access, worker import path, word hashing.

Null handling common to all operators: a null text counts as the empty text; rows whose id
is null take no part in joins between documents (each operator says what it returns).
Operators read the columns they need under their own names, so extra columns of the input,
whatever they are called, cannot clash.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestar.session import fresh_workspace

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when they share the driver's file system.

    On clusters that do not, the package travels with ``--py-files`` as usual.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` only, null texts as empty."""
    return df.select(F.col(id_col).alias("doc_id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def stored(df: DataFrame, *name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back (lineage ends there)."""
    path = fresh_workspace(df.sparkSession, *name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_mod(col: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n`` (the hold-out folds)."""
    return F.crc32(col.cast("string").cast("binary")) % n


# ---- word hashing ---------------------------------------------------------------------

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(_BASE, _BLOCK + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), _BLOCK + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), element by element."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the text's words (runs of letters and digits, lower-cased), in order.

    Works on blocks of 256 KiB cut between words, so scratch memory stays bounded for very
    long texts; only a single word longer than a block is itself cut.
    """
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    out, at = [], 0
    while at < len(raw):
        end = min(at + _BLOCK, len(raw))
        if end < len(raw):
            gaps = np.flatnonzero(~_IS_WORD[raw[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
        block = raw[at:end]
        at = end
        inside = np.zeros(len(block) + 2, np.int8)
        inside[1:-1] = _IS_WORD[block]
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * _POW[: len(block)], out=sums[1:])
        out.append(mix((sums[ends] - sums[starts]) * _INV[starts]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def batches(frames: Iterable, rows: int) -> Iterator:
    """Cut Arrow batches into slices of at most ``rows`` rows."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at:at + rows]
