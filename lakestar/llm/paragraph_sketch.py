"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (lines, long lines cut at sentence ends) are digested to 64 bits, repeated
paragraphs labelled by occurrence, and each digest is added to three cells of a small table;
a cell holds a count, the xor of its digests and the xor of their check values.  Subtracting
the tables of two versions leaves the cells of the differing paragraphs; peeling cells that
hold a single digest recovers them, and where peeling gets stuck both tables are built again
with four times the cells.  Likeness is the Jaccard coefficient that follows from the recovered
difference.

Versions compared here: each document, the same text with its last quarter replaced by the
start of the next document (ascending id), and the next document.  The next document is found
without a global window: documents go to blocks of consecutive ids, and the first document of
each block is also sent to the block before it.

Defined cases: null texts count as empty; two texts without paragraphs are alike (1.0);
repeated ids are ordered by text, so the next of a repeated row may have the same id; a null
id sorts first; a single row is its own next; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestar.llm.common import batches, id_and_text, mix, ship

#: Cells of a fingerprint; cells of a digest; growth of the tables after a failed peeling.
CELLS, HASHES, GROWTH = 24, 3, 4

_MULTIPLIERS = (mix(np.arange(1, HASHES + 2, dtype=np.uint64)) | np.uint64(1))[:, None]

# A line, cut after 100 to 300 characters at a sentence end, else after 200 to 400 at a space.
_PARAGRAPHS = re.compile(r"[^\n]{100,300}?[.!?](?=\s)|[^\n]{200,400}?(?=[^\S\n])|[^\n]{1,400}")


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of a text's paragraphs, labelled by occurrence, in order."""
    seen: Counter = Counter()
    out = []
    for m in _PARAGRAPHS.finditer(text):
        paragraph = m.group().strip()
        if paragraph:
            nth = seen[paragraph]
            seen[paragraph] = nth + 1
            key = paragraph if nth == 0 else f"{paragraph}\n{nth}"
            out.append(hashlib.blake2b(key.encode("utf-8", "replace"), digest_size=8).digest())
    return np.frombuffer(b"".join(out), np.uint64)


@dataclass
class Sketch:
    """Cells as counts, key xors and check xors."""

    counts: np.ndarray
    keys: np.ndarray
    checks: np.ndarray

    @classmethod
    def empty(cls, cells: int) -> Sketch:
        return cls(np.zeros(cells, np.int32), np.zeros(cells, np.uint64),
                   np.zeros(cells, np.uint32))

    @classmethod
    def of(cls, keys: np.ndarray, cells: int = CELLS) -> Sketch:
        sketch = cls.empty(cells)
        sketch.toggle(keys, np.ones(len(keys), np.int32))
        return sketch

    def toggle(self, keys: np.ndarray, signs: np.ndarray) -> None:
        """Add (or, with sign -1, remove) digests."""
        at = _places(keys, len(self.counts)).ravel()
        np.add.at(self.counts, at, np.concatenate([signs] * HASHES))
        np.bitwise_xor.at(self.keys, at, np.concatenate([keys] * HASHES))
        np.bitwise_xor.at(self.checks, at, np.concatenate([_check(keys)] * HASHES))

    def __sub__(self, other: Sketch) -> Sketch:
        return Sketch(self.counts - other.counts, self.keys ^ other.keys,
                      self.checks ^ other.checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Digests on the one side and on the other; None where peeling gets stuck."""
        ours, theirs = [], []
        while True:
            pure = np.flatnonzero(np.abs(self.counts) == 1)
            pure = pure[self.checks[pure] == _check(self.keys[pure])]
            if not len(pure):
                break
            keys, first = np.unique(self.keys[pure], return_index=True)
            signs = self.counts[pure][first]
            ours.append(keys[signs > 0])
            theirs.append(keys[signs < 0])
            self.toggle(keys, -signs)
        if self.counts.any() or self.keys.any() or self.checks.any():
            return None
        none = [np.empty(0, np.uint64)]
        return np.concatenate(ours or none), np.concatenate(theirs or none)

    def text(self) -> str:
        """The cells as base64 (little-endian counts, keys, checks)."""
        return base64.b64encode(self.counts.astype("<i4").tobytes()
                                + self.keys.astype("<u8").tobytes()
                                + self.checks.astype("<u4").tobytes()).decode()


def _check(keys: np.ndarray) -> np.ndarray:
    return (keys * _MULTIPLIERS[0, 0] >> np.uint64(32)).astype(np.uint32)


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """One cell in each third of the table (digests are uniform: a product's top bits do)."""
    third = cells // HASHES
    at = (keys * _MULTIPLIERS[1:] >> np.uint64(33)) % np.uint64(third)
    return at.astype(np.int64) + np.arange(0, cells, third)[:HASHES, None]


def difference(a: np.ndarray, b: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Digests in ``a`` only and in ``b`` only, recovered from subtracted sketches."""
    while True:
        found = (Sketch.of(a, cells) - Sketch.of(b, cells)).peel()
        if found is not None:
            return found
        cells *= GROWTH


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard coefficient of two digest sets, from their recovered difference."""
    only_a, only_b = difference(a, b)
    total, apart = len(a) + len(b), len(only_a) + len(only_b)
    return (total - apart) / (total + apart) if total else 1.0


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    part = len(text) // 4
    return text[:len(text) - part] + following[:part]


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt to blocks of consecutive ids, sorted; ``extra`` marks a following block's head."""
    spark = docs.sparkSession
    rows = id_and_text(docs).withColumn("at", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # One narrow pass over ids; the driver sees one number a block.
    cuts = np.array(sorted(set(rows.select(F.percentile_approx(
        "at", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or [])), np.int64)

    @F.pandas_udf("long")
    def block_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), "right"))

    heads = rows.select("at", block_of("at").alias("block")).groupBy("block").agg(
        F.min("at").alias("head")).orderBy("block").collect()
    firsts = np.array([r["head"] for r in heads], np.int64)
    before = np.array([heads[i - 1]["block"] for i in range(len(heads))], np.int64)

    @F.pandas_udf("long")
    def block_before(ids: pd.Series) -> pd.Series:
        at = np.minimum(np.searchsorted(firsts, ids.to_numpy()), len(firsts) - 1)
        return pd.Series(before[at]).where(firsts[at] == ids.to_numpy()).astype("Int64")

    places = F.array_compact(F.array(
        F.struct(block_of("at").alias("block"), F.lit(0).alias("extra")),
        F.when(block_before("at").isNotNull(),
               F.struct(block_before("at").alias("block"), F.lit(1).alias("extra")))))
    dealt = rows.withColumn("place", F.explode(places)).select("doc_id", "at", "text", "place.*")
    return (dealt.repartitionById(len(cuts) + 1, F.col("block").cast("int"))
            .sortWithinPartitions("block", "extra", "at", "text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and both likenesses of every row."""
    ship(docs.sparkSession)
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
               "near_edited", "near_next"]

    def row(doc_id, text: str, own: np.ndarray, following: str, after: np.ndarray) -> tuple:
        other = edited(text, following)
        changed = digests(other)
        return (doc_id, len(text), hashlib.sha256(other.encode("utf-8", "replace")).hexdigest(),
                Sketch.of(own).text(), Sketch.of(changed).text(),
                likeness(own, changed), likeness(own, after))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row whose next row is still to come
        for part in batches(frames, 256):
            out = []
            for doc_id, text, block, extra in zip(part["doc_id"], part["text"], part["block"],
                                                  part["extra"], strict=True):
                keys = digests(text)
                if held is not None and held[0] == block:
                    out.append(row(*held[1:], text, keys))
                held = None if extra else (block, doc_id, text, keys)
            yield pd.DataFrame(out, columns=columns)

    ids = docs.schema["doc_id"].dataType.simpleString()
    return _with_next(docs).mapInPandas(
        run, f"doc_id {ids}, n_chars long, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")
