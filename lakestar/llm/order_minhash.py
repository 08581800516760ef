"""Near-duplicates by order MinHash, verified by banded alignment.

A text's words are read in shingles of five, each labelled by its occurrence.  A sketch keeps
the ``PICKS`` shingles of smallest hash and retains their order in the text; equal sketches
therefore speak of a small edit distance, not only of common shingles.  Texts that share one
of ``SKETCHES`` sketches are candidates.

Candidates are verified on their words: a banded alignment (furthest-reaching points by number
of edits) gives the runs both texts share in order, and the similarity is the share of
distinct shingles inside those runs among the distinct shingles of both texts.

Texts with the same words are one class from the start.  Inside a bucket of equal sketches no
pairs are listed: one member is elected centre and meets the members outside its class.
Rounds go on over the buckets that still hold several classes, electing first the members
with most links, then others by draw, while a round links many texts.  What the elections
leave is compared in full: every pair of a bucket that is still in different classes and was
not verified yet, block by block.  There a pair is passed over only when it provably cannot be
alike: by its numbers of distinct shingles, or by the parities of their hashes, which differ
in at most as many places as the shingles of the two texts.  Classes are the connected
components, found by label propagation over checkpointed tables; a later round propagates
over the classes that its new links join.

Defined cases: texts without words are alike only if equal; texts of fewer than five words are
one shingle; a null text counts as empty; rows with a null id take no part and get a null
class; repeated rows share a class; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestar.llm.common import batches, id_and_text, mix, ship, stored, word_hashes
from lakestar.session import cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
#: Shingles of a sketch, sketches of a text: a pair at similarity 0.8 is missed by all
#: sketches with probability (1 - 0.8 ** 3) ** 16, about 1e-5.
PICKS, SKETCHES = 3, 16
#: Rounds of elections that always run; further ones run while a round links at least one in
#: ``YIELD`` of the pairs it tests.  Below that most members are unlike their centres, and all
#: pairs that the rounds leave are compared by parities instead, which is exact and cheaper.
#: Sketch numbers that the first round reads; centres that a bucket elects in the third and on.
LEAST_ROUNDS, YIELD, OPENING, SLOTS = 2, 4, 4, 2
#: Members of a bucket that are compared in one block; words of a text's shingle parities.
BLOCK, PARITIES = 1024, 16

_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0x100000001B3)


def shingles(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of the word shingles; a shorter text is one shingle."""
    if not len(words):
        return np.empty(0, np.uint64)
    size = min(SHINGLE, len(words))
    h = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        h = (h ^ words[k:len(words) - size + 1 + k].astype(np.uint64)) * _STEP
        h ^= h >> np.uint64(29)
    return mix(h)


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes that tell the occurrences of a repeated shingle apart."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if new.all():
        return h
    starts = np.flatnonzero(new)
    nth = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    out = np.empty_like(h)
    out[order] = ranked + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


def sketches(words: np.ndarray) -> list[int]:
    """Order MinHash sketches of a text's words."""
    h = labelled(shingles(words))
    if not len(h):
        return []
    picks = min(PICKS, len(h))
    kept = np.empty((SKETCHES, picks), np.uint64)
    for row, seed in zip(kept, _SEEDS, strict=True):
        keyed = (h ^ seed) * (seed | np.uint64(1))
        keyed ^= keyed >> np.uint64(32)
        at = np.argpartition(keyed, picks - 1)[:picks] if len(h) > picks else np.arange(len(h))
        row[:] = h[np.sort(at)]  # in text order
    value = _SEEDS.copy()
    for column in kept.T:
        value = (value ^ column) * _STEP
    return mix(value).view(np.int64).tolist()


def _runs(a: np.ndarray, b: np.ndarray, limit: int) -> list[tuple[int, int]] | None:
    """(first place in ``a``, length) of the runs kept by an alignment of at most ``limit`` edits."""
    n, m = len(a), len(b)
    goal = m - n
    if abs(goal) > limit:
        return None

    def slide(i: int, k: int) -> int:
        """The end of the equal run from a[i] and b[i + k]."""
        stop, step = min(n, m - k), 32
        while i < stop:
            end = min(i + step, stop)
            unlike = a[i:end] != b[i + k:end + k]
            at = int(unlike.argmax())
            if unlike[at]:
                return i + at
            i, step = end, step * 4
        return i

    # By edits: the first diagonal; start, end and origin of every diagonal (negative: unreached).
    reach: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    for d in range(limit + 1):
        # Diagonals from which the goal can still be reached within the limit.
        low, high = max(-d, goal - (limit - d), -n), min(d, goal + (limit - d), m)
        k = np.arange(low, high + 1, dtype=np.int32)
        if d == 0:
            start, origin = np.zeros(1, np.int32), k
        else:
            first, _, ends, _ = reach[-1]
            last = np.full(len(k) + 2, -9, np.int32)  # of the diagonals low - 1 to high + 1
            x, y = max(first, low - 1), min(first + len(ends) - 1, high + 1)
            last[x - low + 1:y - low + 2] = ends[x - first:y - first + 1]
            options = np.stack([last[2:] + 1, last[1:-1] + 1, last[:-2]])
            options[(options > n) | (options + k > m) | (options < 0)] = -9
            best = options.argmax(axis=0)
            start, origin = options.max(axis=0), k + 1 - best.astype(np.int32)
        end = start.copy()
        inside = np.flatnonzero((start >= 0) & (start < n) & (start + k < m))
        for x in inside[a[start[inside]] == b[start[inside] + k[inside]]]:
            end[x] = slide(int(start[x]), int(k[x]))
        reach.append((low, start, end, origin))
        if low <= goal <= high and end[goal - low] >= n:
            out = []
            at = goal
            for first, starts, ends, origins in reach[::-1]:
                s, e = int(starts[at - first]), int(ends[at - first])
                if e > s:
                    out.append((s, e - s))
                at = int(origins[at - first])
            return out[::-1]
    return None


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Share of distinct shingles aligned in order; 0 where it cannot reach ``SIMILARITY``."""
    sa, sb = shingles(a), shingles(b)
    ua, ub = np.unique(sa), np.unique(sb)
    common = len(np.intersect1d(ua, ub, assume_unique=True))
    union = len(ua) + len(ub) - common
    if union == 0 or common < SIMILARITY * union:
        return 0.0  # no alignment can keep more shingles than both texts have
    need = int(np.ceil(SIMILARITY * union - 1e-9))
    size = min(SHINGLE, len(a), len(b))
    n = min(len(a), len(b))
    if (a[:n] == b[:n]).all():
        runs = [(0, n)]  # one text continues the other
    else:
        # An alignment that keeps ``need`` shingles keeps at least ``need + size - 1`` words of
        # each text; every other word of either text is at most one edit.
        runs = _runs(a, b, len(a) + len(b) - 2 * (need + size - 1)) or []
    kept = [sa[s:s + k - size + 1] for s, k in runs if k >= size]
    return len(np.unique(np.concatenate(kept))) / union if kept else 0.0


def parities(words: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of distinct shingles, and the parity of their count in each of the hash places.

    Two texts' parities differ in at most as many places as shingles are in one text only.
    """
    h = np.unique(shingles(words))
    odd = np.bincount((h >> np.uint64(7)) % np.uint64(64 * PARITIES), minlength=64 * PARITIES) & 1
    return len(h), np.packbits(odd.astype(bool)).view(np.uint64)


def _near_rows(groups: np.ndarray, sides: np.ndarray, classes: np.ndarray, sizes: np.ndarray,
               odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group, sorted by group and size, that may reach ``SIMILARITY``.

    Groups of two sides compare rows across them, others all rows.
    """
    first, second = [], []
    live = np.arange(len(groups))
    for step in range(1, len(groups)):
        live = live[live + step < len(groups)]
        other = live + step
        # Sizes rise inside a group: a row whose partner is too large needs no further one.
        on = (groups[other] == groups[live]) & (sizes[live] >= SIMILARITY * sizes[other] - 1e-9)
        live, other = live[on], other[on]
        if not len(live):
            break
        ask = (classes[live] != classes[other]) & ((sides[live] != sides[other]) | (sides[live] < 0))
        x, y = live[ask], other[ask]
        unlike = np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1)
        may = unlike <= (1 - SIMILARITY) / (1 + SIMILARITY) * (sizes[x] + sizes[y]) + 1e-6
        first.append(x[may])
        second.append(y[may])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *second])


# ---- distributed part -------------------------------------------------------------------


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, key (digest of the words) and sketches of every row with an id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches(frames, 256):
            words = [word_hashes(t) for t in part["text"]]
            yield pd.DataFrame({
                "doc_id": part["doc_id"],
                "key": [_key(w, t) for w, t in zip(words, part["text"], strict=True)],
                "sketches": [sketches(w) for w in words]})

    ids = docs.schema["doc_id"].dataType.simpleString()
    return (id_and_text(docs).where("doc_id is not null")
            .mapInPandas(run, f"doc_id {ids}, key binary, sketches array<long>"))


def _key(words: np.ndarray, text: str) -> bytes:
    raw = words.tobytes() if len(words) else b"\x00" + text.encode("utf-8", "replace")
    return hashlib.blake2b(raw, digest_size=16).digest()


def _members(texts: DataFrame) -> DataFrame:
    """bucket, nth, key: the distinct texts in every bucket of equal sketches that holds several."""
    entries = texts.select("key", F.posexplode("sketches").alias("nth", "sketch")).select(
        F.xxhash64("nth", "sketch").alias("bucket"), "nth", "key")
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return stored(entries.join(shared, "bucket"), "near")


def _words_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, words (32-bit hashes) of the wanted (doc_id, key); each text moves once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches(frames, 256):
            words = [word_hashes(t) for t in part["text"]]
            same = [_key(w, t) == bytes(k) for w, t, k in
                    zip(words, part["text"], part["key"], strict=True)]
            yield pd.DataFrame({"key": part["key"], "words": [
                (w >> np.uint64(32)).astype(np.uint32).tobytes() for w in words]})[same]

    rows = id_and_text(docs).join(
        wanted.select(F.col("doc_id").alias("wanted"), "key").hint("shuffle_hash"),
        F.col("doc_id") == F.col("wanted"))
    # A repeated row may give its text twice.
    return rows.select("key", "text").mapInPandas(run, "key binary, words binary").dropDuplicates(["key"])


def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (a, b) whose aligned similarity reaches the threshold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches(frames, 1024):
            good = [similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32))
                    >= SIMILARITY for x, y in zip(part["wa"], part["wb"], strict=True)]
            yield part.loc[good, ["a", "b"]]

    return (pairs.join(words.select(F.col("key").alias("a"), F.col("words").alias("wa")), "a")
            .join(words.select(F.col("key").alias("b"), F.col("words").alias("wb")), "b")
            .select("a", "b", "wa", "wb").mapInPandas(run, "a binary, b binary"))


def components(links: DataFrame) -> DataFrame:
    """key, class: the smallest key of each connected component of the links (a, b).

    Every round takes the smallest label around each key, then the label of that label.
    """
    both = stored(links.select("a", "b").unionByName(
        links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near")
    labels = cut_lineage(both.groupBy(F.col("a").alias("key")).agg(
        F.least(F.min("b"), F.col("key")).alias("class")))
    while True:
        around = (both.join(labels.select(F.col("key").alias("b"), "class"), "b")
                  .groupBy(F.col("a").alias("key")).agg(F.min("class").alias("near")))
        lower = labels.join(around, "key").select(
            "key", F.col("class").alias("was"), F.least("class", "near").alias("class"))
        jump = lower.select(F.col("key").alias("class"), F.col("class").alias("further"))
        after = cut_lineage(lower.join(jump, "class", "left").select(
            "key", "was", F.least("class", "further").alias("class")))
        labels = after.select("key", "class")
        if after.where(F.col("was") != F.col("class")).isEmpty():
            return labels


def _open(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """bucket, key, class: the members of buckets that still hold several classes."""
    if labels is None:
        return members.select("bucket", "key", F.col("key").alias("class"))
    named = members.select("bucket", "key").join(labels, "key", "left").withColumn(
        "class", F.coalesce("class", "key"))
    mixed = named.groupBy("bucket").agg(
        F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
    return stored(named.join(mixed.select("bucket"), "bucket"), "near")


def _elect(members: DataFrame, links: DataFrame | None, turn: int) -> DataFrame:
    """bucket, centre, of (its class): the centres of a round.

    The second round takes the member with most links, the others draw by a hash, the same in
    all buckets, so that buckets of the same texts elect the same centre; from the third on one
    in each slot.
    """
    draw = F.xxhash64("key", F.lit(turn))
    if turn == 2:
        degree = (links.select(F.explode(F.array("a", "b")).alias("key"))
                  .groupBy("key").agg(F.count("*").alias("links")))
        members = members.join(degree, "key", "left")
        rank = F.struct(F.coalesce("links", F.lit(0)).alias("links"), draw.alias("draw"), "key", "class")
    else:
        rank = F.struct(F.lit(0).alias("links"), draw.alias("draw"), "key", "class")
    slots = 1 if turn <= 2 else SLOTS
    slot = F.pmod(F.xxhash64("key", F.lit(-turn)), F.lit(slots))
    best = members.groupBy("bucket", slot.alias("slot")).agg(F.max(rank).alias("c"))
    return best.select("bucket", F.col("c.key").alias("centre"), F.col("c.class").alias("of"))


def _left(members: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (a, b) of open buckets' members of different classes that may be alike.

    A bucket of more than ``BLOCK`` members is cut into blocks, and each two of them meet in a
    group of their own; groups are read as a stream, so a task holds one group at a time.
    """

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches(frames, 1024):
            found = [parities(np.frombuffer(w, np.uint32)) for w in part["words"]]
            yield pd.DataFrame({"key": part["key"], "size": [n for n, _ in found],
                                "odd": [odd.tobytes() for _, odd in found]})

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        group = rows[["bucket", "low", "high"]].to_numpy()
        number = np.concatenate([[0], np.cumsum((group[1:] != group[:-1]).any(axis=1))])
        odd = np.frombuffer(b"".join(rows["odd"]), np.uint64).reshape(len(rows), PARITIES)
        x, y = _near_rows(number, rows["side"].to_numpy(), pd.factorize(rows["class"])[0],
                          rows["size"].to_numpy(), odd)
        keys = rows["key"].to_numpy()
        pairs = {(min(p, q), max(p, q)) for p, q in zip(keys[x], keys[y], strict=True)}
        return pd.DataFrame(sorted(pairs), columns=["a", "b"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for part in batches(frames, 4096):
            group = part[["bucket", "low", "high"]].to_numpy()
            last = (group == group[-1]).all(axis=1)
            whole = int(len(last) - last[::-1].argmin()) if not last.all() else 0
            if held and (whole or (held[-1][["bucket", "low", "high"]].to_numpy()[-1] != group[0]).any()):
                yield compared(pd.concat([*held, part.iloc[:whole]]))
                held = []
            elif whole:
                yield compared(part.iloc[:whole])
            held.append(part.iloc[whole:])
        if held:
            yield compared(pd.concat(held))

    sizes = members.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("key", "bucket"), F.col("blocks")).cast("int")
    met = (members.join(sizes, "bucket").withColumn("block", block)
           .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("bucket", "key", "class", F.least("block", "with").alias("low"),
                   F.greatest("block", "with").alias("high"),
                   F.when(F.col("block") == F.col("with"), -1).otherwise(F.col("block")).alias("side")))
    facts = stored(words.join(members.select("key").distinct(), "key", "left_semi").mapInPandas(
        measured, "key binary, size int, odd binary"), "near")
    return (met.join(facts, "key").repartition("bucket", "low", "high")
            .sortWithinPartitions("bucket", "low", "high", "size")
            .mapInPandas(run, "a binary, b binary").distinct())


def _merged(labels: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """The labels after new links: components of the classes that the links join."""
    if labels is None:
        return components(fresh)
    ends = []
    for side in ("a", "b"):
        fresh = fresh.join(labels.select(F.col("key").alias(side), F.col("class").alias(f"of_{side}")),
                           side, "left")
        ends.append(F.coalesce(f"of_{side}", side).alias(side))
    joined = components(fresh.select(*ends).distinct())
    known = labels.join(joined.select(F.col("key").alias("class"), F.col("class").alias("now")),
                        "class", "left").select("key", F.coalesce("now", "class").alias("class"))
    # Texts that were in no class so far have themselves as key.
    added = joined.join(labels.select("key"), "key", "left_anti")
    return stored(known.unionByName(added), "near")


def duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest id of its class) for every row of ``docs``."""
    return _classes(docs, *_classified(docs))


def _classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, key), and the texts (key, doc_id, class)."""
    ship(docs.sparkSession)
    rows = stored(_sketched(docs), "near")
    texts = stored(rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"),
                                           F.first("sketches").alias("sketches")), "near")
    members = _members(texts)
    words = stored(_words_of(docs, texts.select("key", "doc_id").join(
        members.select("key").distinct(), "key")), "near")
    links = labels = tested = None
    turn, asked, added = 1, 0, 0
    while not words.isEmpty():
        if turn == 1:
            # Texts alike in some sketches mostly are in the others, and meet there in one class.
            held = _open(members.where(F.col("nth") < OPENING), labels)
        else:
            members = held = _open(members, labels)
        last = turn > LEAST_ROUNDS and added * YIELD < max(asked, 1)
        if last:
            pairs = _left(held, words)
        else:
            met = held.join(_elect(held, links, turn), "bucket").where(
                F.col("class") != F.col("of"))
            pairs = met.select(F.least("key", "centre").alias("a"),
                               F.greatest("key", "centre").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "near")
        fresh = stored(_verified(pairs, words), "near")
        tested, links = _and(tested, pairs), _and(links, fresh)
        asked, added = pairs.count(), fresh.count()
        if added:
            labels = _merged(labels, fresh)
        if last:
            break
        turn += 1
    if labels is None:
        return rows, texts.select("key", "doc_id", F.col("key").alias("class"))
    return rows, texts.join(labels, "key", "left").select(
        "key", "doc_id", F.coalesce("class", "key").alias("class"))


def _and(so_far: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if so_far is None else so_far.unionByName(more)


def _classes(docs: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Every row's class id; rows with a null id have none."""
    ids = texts.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    named = texts.join(ids, "class").select("key", "class_id")
    found = rows.select("doc_id", "key").join(named, "key").select("doc_id", "class_id")
    nameless = docs.where("doc_id is null").select(
        "doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("class_id"))
    return found.unionByName(nameless)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the one of smallest id (rows without id stay).

    An id that carries several texts keeps the rows of those that stand for their class.
    """
    rows, texts = _classified(docs)
    kept = stored(texts.groupBy("class").agg(F.min(F.struct("doc_id", "key")).alias("c"))
                  .select("c.doc_id", "c.key"), "near")
    single = docs.join(kept.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    repeated = stored(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"), "near")
    if not repeated.isEmpty():

        @F.pandas_udf("binary")
        def digest(part: pd.Series) -> pd.Series:
            return pd.Series([_key(word_hashes(t), t) for t in part])

        several = (single.join(repeated, "doc_id", "left_semi")
                   .select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                           F.col("doc_id"), digest(F.coalesce("text", F.lit(""))).alias("key"))
                   .join(kept, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"]))
        single = (single.join(repeated, "doc_id", "left_anti")
                  .unionByName(several.select("row.*")))
    return single.unionByName(docs.where("doc_id is null"))
