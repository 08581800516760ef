"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

A document's tokens (its ids and the end mark) are one piece, or, where longer than the
capacity, a first piece of the remainder and full pieces after it.

Pieces of one length are interchangeable, and so are sequences with the same room left.  So
documents and gaps are range-sorted as runs: at most ``capacity`` runs of each, however many
documents there are, counted by one distributed aggregation.  A bulk-synchronous step takes
the run of longest waiting documents (rank decides between documents that want one gap),
finds the successor of its length among the gaps, places as many documents as that run of
gaps holds, and moves the filled gaps to their new lengths; the steps repeat until no
document waits.  Where no gap fits, new sequences are opened.  The result is that of
sequential best-fit decreasing.

Every step is an interval: the documents of one length and of certain ranks go to consecutive
sequences at one offset.  Ranks are dealt in a distributed way (a running number within each
task, plus the counts of the tasks before it), and one join of length and rank with the
intervals places every row.

Defined cases: a null or empty text is the end mark alone; repeated rows are packed each; an
empty table gives no rows; a null id is carried through; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakestar.llm.common import batches, id_and_text, ship, stored
from lakestar.llm.token_count import byte_symbols

CAPACITY, END = 2048, 0
# Fixed value: the pre-split pattern of byte-level BPE files.
_SPLIT = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Units whose ids a worker keeps, in each of two generations (speed only, not results).
MEMO = 250_000
#: Ranks of one length are joined to their intervals in blocks of so many, so no length is hot.
RANK_BLOCK = 1 << 16

# White space as Unicode has it (Python's \s also takes U+001C..U+001F).
_W = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The tokenizer's pre-split cuts at white space like this; a unit is split further by it alone.
_UNITS = re.compile(f" ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]").findall


class _Memo(dict):
    """Ids of units; a unit not seen before is looked up among the older ones or encoded."""

    def __init__(self, older: dict, encode):
        self._older, self._encode = older, encode

    def __missing__(self, unit: str) -> bytes:
        ids = self._older.get(unit)
        if ids is None:
            ids = array("I", self._encode(unit)).tobytes()
        if len(unit) <= 64:
            self[unit] = ids
        return ids


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    A text is split at white space as the tokenizer's own pattern splits it, and every unit is
    encoded once.  Files whose ids rise with their merges, as byte-level files do, are run by
    the faster of the two libraries that implement them; ids are the same.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._encode = _by_ranks(path) or self._plain
        self._memo = _Memo({}, self._encode)

    def _plain(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        """Ids of a text; one that holds a special string is encoded whole."""
        if any(s in text for s in self._special):
            return array("I", self._plain(text)).tobytes()
        if len(self._memo) > MEMO:
            self._memo = _Memo(dict(self._memo), self._encode)
        return b"".join(map(self._memo.__getitem__, _UNITS(text)))


def _by_ranks(path: str):
    """An encoder of plain text by merge ranks, if the file's ids are its merge order."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(set(merged)) or model.get("end_of_word_suffix"):
        return None
    byte_of = {symbol: b for b, symbol in enumerate(byte_symbols())}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
    return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks,
                             special_tokens={}).encode_ordinary


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the remainder first, then full ones."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; a narrow pass.

    ``task`` and ``nth`` number the pieces of one length within each task.
    """
    ship(docs.sparkSession)
    end = np.array([END], "<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder = _encoder(path)
        seen: Counter = Counter()
        for part in batches(frames, 256):
            rows = []
            for doc_id, ids in zip(part["doc_id"], map(encoder.encode, part["text"]), strict=True):
                ids += end
                for i, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start:4 * (start + n)])
                    rows.append((doc_id, i, start, n, crc, task, seen[n]))
                    seen[n] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32",
                                              "task", "nth"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return id_and_text(docs).mapInPandas(
        run, f"doc_id {ids}, piece int, start long, length long, ids_crc32 long, task int, nth long")


def intervals(waiting: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """(length, first rank, end rank, first sequence, offset) that place runs of documents.

    ``waiting``: documents of each length.  Best-fit decreasing over whole runs.
    """
    gaps: list[int] = []  # distinct rooms left, ascending
    runs: dict[int, deque[tuple[int, int]]] = {}  # room -> runs of (first sequence, count)
    out: list[tuple[int, ...]] = []
    opened = 0

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                insort(gaps, room)
                runs[room] = deque()
            runs[room].append((first, n))

    for length in sorted(waiting, reverse=True):
        rank, left = 0, waiting[length]
        while left:
            at = bisect_left(gaps, length)
            room = gaps[at] if at < len(gaps) else capacity
            each = room // length
            need = -(-left // each)
            if at < len(gaps):
                first, n = runs[room].popleft()
                add_back = (first + need, n - need) if n > need else None
                n = min(n, need)
                if add_back:
                    runs[room].appendleft(add_back)
                elif not runs[room]:
                    del runs[room]
                    gaps.pop(at)
            else:
                first, n = opened, need
                opened += need
            # Each of the n sequences takes a document, then the next, while some wait.
            for k in range(each):
                placed = min(left, n)
                if placed:
                    out.append((length, rank, rank + placed, first, capacity - room + k * length))
                # Sequences that get none this time keep the room they have.
                add(room - k * length, first + placed, n - placed)
                rank, left, n = rank + placed, left - placed, placed
            add(room - each * length, first, n)
    return out


def _block(rank: str, add: int = 0) -> Column:
    return F.floor((F.col(rank) + add) / RANK_BLOCK)


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (with length, and task and nth as :func:`pieces` numbers them) with
    sequence_id and offset."""
    spark = rows.sparkSession
    counts = stored(rows.groupBy("length", "task").agg(F.count("*").alias("n")), "best_fit")
    sizes = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # <= capacity rows
    plan = intervals({r["length"]: r["n"] for r in sizes}, capacity)
    # A written table has a known size, so the planner decides whether it is broadcast.
    table = stored(spark.createDataFrame(
        plan, "of long, first long, end long, sequence long, offset long").withColumn(
        "block", F.explode(F.sequence(_block("first"), _block("end", -1)))), "best_fit")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1)
    dealt = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    ranked = rows.join(dealt, ["length", "task"]).withColumn("rank", F.col("skip") + F.col("nth"))
    return ranked.join(table, (F.col("length") == F.col("of")) & (_block("rank") == F.col("block"))
                       & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))).withColumn(
        "sequence_id", F.col("sequence") + F.col("rank") - F.col("first")).drop(
        "task", "nth", "skip", "rank", "of", "first", "end", "sequence", "block")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return place(stored(pieces(docs, path, capacity), "pieces"), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
