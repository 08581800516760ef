"""Periodic runs of words, found by longest common extensions over a difference cover.

The words of a text are numbered.  A run of smallest period q is a stretch in which words q
apart are the same, of at least ``MIN_LENGTH`` words and ``MIN_PERIODS`` periods, that no
neighbouring word extends.

* **Grid.** A run of period p holds, whatever its place, a multiple i of the grid's step for p
  with i and i + p both inside.  Steps grow with p, so all grids together hold about
  n log n places; most fall at the first comparison, words i and i + p being different.
* **Extensions.** How far the words from i and from i + p agree is asked of a structure over
  the suffixes at the places of a difference cover: two places reach a sampled pair after the
  same few words, which are compared one by one; beyond them the answer is the least common
  prefix between two sorted samples, a range minimum read from a sparse table.  The same
  structure over the reversed words extends backwards.  It is built only for texts in which
  some grid pair has eight words in common.

Both extensions of a grid pair give a run's ends; among equal ends the smallest period stays.

Defined cases: a null text has no words; texts of fewer than ``MIN_LENGTH`` words have no run;
repeated rows are each read; a null id counts as empty text where it is hashed; an empty table gives no rows; extra columns
are ignored.  A text is read whole, by one task; memory is in proportion to its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestar.llm.common import batches, ship

MIN_LENGTH, MIN_PERIODS = 24, 3
#: The cover of SIDE * SIDE holds the residues below SIDE and the multiples of SIDE: every
#: difference is one of the second less one of the first.
SIDE = 4
COVER = SIDE * SIDE
#: Words compared one by one, to either side, before the structure is asked.
GLANCE = 8
#: Grids of texts up to so many words are kept ready; others come in blocks of pairs.
READY, PAIRS = 4096, 1 << 20

_IN_COVER = np.array([r < SIDE or r % SIDE == 0 for r in range(COVER)])


def _ranked(keys: np.ndarray) -> np.ndarray:
    """The rank of every key among the distinct keys."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


class Extensions:
    """Longest common extensions of pairs of places in one text."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        # Past the end stand zeros, which no word is.
        self.words = np.concatenate([words.astype(np.int64) + 1, np.zeros(COVER + 1, np.int64)])
        self._sorted = False

    def _sort_samples(self) -> None:
        """Sorted sampled suffixes, and the minima of their neighbours' common prefixes."""
        n, words = self.n, self.words
        places = np.flatnonzero(_IN_COVER[np.arange(n) % COVER])
        index = np.full(n, -1, np.int64)
        index[places] = np.arange(len(places))
        # By the first COVER words, several at a time as long as they fit in a key.
        base = int(words.max()) + 1
        together = max(1, (62 - len(places).bit_length()) // base.bit_length())
        rank = np.zeros(len(places), np.int64)
        for at in range(0, COVER, together):
            for t in range(at, min(at + together, COVER)):
                rank = rank * base + words[places + t]
            rank = _ranked(rank)
        # Then by twice as many words each time; places + width are samples again.
        levels, width = [rank], COVER
        while int(rank.max()) + 1 < len(places):
            after = places + width
            follow = np.zeros(len(places), np.int64)
            inside = after < n
            follow[inside] = rank[index[after[inside]]] + 1
            rank = _ranked(rank * (len(places) + 1) + follow)
            levels.append(rank)
            width *= 2
        self.rank = np.full(n, -1, np.int64)
        self.rank[places] = rank
        order = places[np.argsort(rank)]
        self.minima = [self._neighbours(order, index, levels)]
        span = 1
        while 2 * span <= len(self.minima[0]):
            below = self.minima[-1]
            self.minima.append(np.minimum(below[:-span], below[span:]))
            span *= 2
        self._sorted = True

    def _neighbours(self, order: np.ndarray, index: np.ndarray, levels: list) -> np.ndarray:
        """Words that neighbouring suffixes have in common: whole blocks, then single words."""
        a, b = order[:-1], order[1:]
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + common, b + common
            both = np.flatnonzero((x < self.n) & (y < self.n))
            same = both[levels[k][index[x[both]]] == levels[k][index[y[both]]]]
            common[same] += COVER << k
        return common + self._compared(a + common, b + common, np.full(len(a), COVER))

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree from i and j, one by one, up to ``most``."""
        out = np.zeros(len(i), np.int64)
        live = np.flatnonzero(most > 0)
        step = 0
        while len(live):
            live = live[self.words[i[live] + step] == self.words[j[live] + step]]
            step += 1
            out[live] = step
            live = live[most[live] > step]
        return out

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and from j on (i < j, j at most the number of words)."""
        apart = (j - i) % COVER
        shift = ((-apart) % SIDE - i) % COVER  # from there on both are in the cover
        out = self._compared(i, j, shift)
        more = np.flatnonzero((out == shift) & (j + shift < self.n))
        if len(more):
            if not self._sorted:
                self._sort_samples()
            a, b = self.rank[i[more] + shift[more]], self.rank[j[more] + shift[more]]
            low, high = np.minimum(a, b), np.maximum(a, b)
            k = np.frexp((high - low).astype(float))[1] - 1
            least = np.empty(len(more), np.int64)
            for level in np.unique(k):
                at = np.flatnonzero(k == level)
                row = self.minima[level]
                least[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(level))])
            out[more] += least
        return out


def _step(p: np.ndarray) -> np.ndarray:
    """The places i with i and i + p in a run are at least so many in a row."""
    return np.maximum((MIN_PERIODS - 1) * p, MIN_LENGTH - p)


def _pairs(n: int, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = _step(periods)
    counts = -(-(n - periods) // step)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    first = nth * np.repeat(step, counts)
    return first, first + np.repeat(periods, counts)


@cache
def _ready() -> tuple[np.ndarray, np.ndarray]:
    """The grid of READY words, by the second place: the grid of a shorter text comes first."""
    i, j = _pairs(READY, np.arange(1, READY // MIN_PERIODS + 1))
    order = np.argsort(j, kind="stable")
    return i[order], j[order]


def grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grid pairs (i, i + p) of a text of n words, in blocks."""
    if n <= READY:
        i, j = _ready()
        end = int(np.searchsorted(j, n))
        yield i[:end], j[:end]
        return
    periods = np.arange(1, n // MIN_PERIODS + 1)
    block = np.cumsum(-(-(n - periods) // _step(periods))) // PAIRS
    for part in np.split(periods, np.flatnonzero(np.diff(block)) + 1):
        yield _pairs(n, part)


def _glance(words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs have GLANCE words in common ahead, or as many behind."""
    n = len(words)
    good = np.zeros(len(i), bool)
    for side in (1, -1):
        live = np.arange(len(i))
        for t in range(GLANCE) if side > 0 else range(1, GLANCE + 1):
            x, y = i[live] + side * t, j[live] + side * t
            inside = (x >= 0) & (y < n)
            live = live[inside]
            live = live[words[x[inside]] == words[y[inside]]]
        good[live] = True
    return good


def runs_of(words: np.ndarray) -> np.ndarray:
    """The runs of a text of numbered words: rows (start, length, period), by start and period."""
    n = len(words)
    found = [np.empty((0, 3), np.int64)]
    if n < MIN_LENGTH:
        return found[0]
    ahead = behind = None
    for i, j in grid(n):
        same = np.flatnonzero(words[i] == words[j])
        i, j = i[same].astype(np.int64), j[same].astype(np.int64)
        fits = MIN_PERIODS * (j - i) <= n
        i, j = i[fits], j[fits]
        good = _glance(words, i, j)
        i, j = i[good], j[good]
        if not len(i):
            continue
        if ahead is None:
            ahead, behind = Extensions(words), Extensions(words[::-1])
        start = i - behind.ahead(n - j, n - i)
        length = j + ahead.ahead(i, j) - start
        period = j - i
        kept = length >= np.maximum(MIN_LENGTH, MIN_PERIODS * period)
        found.append(np.stack([start, length, period], axis=1)[kept])
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # A stretch of period q has its multiples as well: the smallest stays.
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def strongest(runs: np.ndarray) -> np.ndarray | None:
    """The run of greatest length / period; ties: smallest start, then period."""
    if not len(runs):
        return None
    whole = runs[:, 1] // runs[:, 2]
    top = runs[whole == whole.max()]
    return min(top.tolist(), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay when every run is cut down to its first period."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(cover[:n]) == 0


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


#: For a row's number and its count of words: which word stands at every place.
Order = Callable[[int, int], np.ndarray | None]


def find_runs(docs: DataFrame, order: Order | None = None, number: Column | None = None) -> DataFrame:
    """The runs of every whole text, and the text without their repetitions.

    ``order`` may read the words of a text in another order (None: as they stand), told by a
    ``number`` of the row.  Returns doc_id, n_words, runs (start, length, period; by start, then
    period), strongest (the run of greatest exponent, null without runs) and collapsed (the
    words that stay, joined by spaces).
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       (F.lit(0) if number is None else number).cast("long").alias("number"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches(frames, 256):
            found = []
            for given, text in zip(part["number"], part["text"], strict=True):
                # Splitting bytes knows ASCII white space only.
                words = text.encode("utf-8", "replace").split()
                numbers = numbered(words)
                placed = order(given, len(words)) if order and words else None
                if placed is not None:
                    numbers = numbers[placed]
                runs = runs_of(numbers)
                if len(runs) or placed is not None:
                    at = np.arange(len(words)) if placed is None else placed
                    words = [words[k] for k in at[kept_words(len(words), runs)]]
                best = strongest(runs)
                found.append((len(numbers), [dict(zip(("start", "length", "period"), r, strict=True))
                                            for r in runs.tolist()],
                             best and dict(zip(("start", "length", "period"), best, strict=True)),
                             b" ".join(words).decode("utf-8")))
            out = pd.DataFrame(found, columns=["n_words", "runs", "strongest", "collapsed"])
            out.insert(0, "doc_id", part["doc_id"].to_numpy())
            yield out

    ids = docs.schema["doc_id"].dataType.simpleString()
    one = "struct<start: long, length: long, period: long>"
    return rows.mapInPandas(
        run, f"doc_id {ids}, n_words long, runs array<{one}>, strongest {one}, collapsed string")


def echoed(h: int, n: int) -> np.ndarray | None:
    """The words of every tenth number repeat a stretch of themselves from some word on."""
    if h % 10:
        return None
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    placed = np.arange(n)
    placed[a:] = a + (placed[a:] - a) % period
    return placed


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document: its number of runs, the strongest, and digests of all runs and of the text."""
    best = F.col("strongest")
    lines = F.transform("runs", lambda r: F.concat(
        r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return find_runs(docs, echoed, number).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
        best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
