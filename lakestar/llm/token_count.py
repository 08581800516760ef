"""Token counts by heap-and-linked-list byte-pair merging (no identifiers are made).

The vocabulary is a word-level BPE file with an end-of-word mark.  A text is split at its
special strings (one token each), then at white space; each chunk falls into pieces by the
file's split pattern, and each piece's symbols (bytes, the last with the end-of-word mark)
are merged: the adjacent pair of lowest rank, leftmost first, is popped from a heap, its two
symbols are joined in a doubly linked list, and the new neighbouring pairs are pushed.  The
count is the initial symbols minus the merges.

Defined cases: null and empty texts have 0 tokens and 0 bytes; repeated rows are counted
each; a null id is carried through; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame

from lakestar.llm.common import id_and_text, ship

LIMIT = 2048
#: Entries of each generation of a worker's chunk and piece memos (speed only, not results).
MEMO = 300_000
#: Number of no symbol: its pairs are in no merge table.
_GONE = 0xFFFFF

# Unicode White_Space (Python's str.split also cuts at U+001C..U+001F).
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte value used by byte-level BPE files."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in kept}
    spare = 256
    for b in range(256):
        if b not in names:
            names[b] = chr(spare)
            spare += 1
    return [names[b] for b in range(256)]


class Memo:
    """Two generations of counts: when the young one is full it becomes the old one."""

    def __init__(self, size: int = MEMO):
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.size = size

    def keep(self, key: str, value: int) -> None:
        if len(key) <= 64:
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[key] = value


class MergeCounter:
    """Counts the tokens of whole texts for one word-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self._first = [vocab[s] for s in symbols]
        self._last = [vocab[s + suffix] for s in symbols]
        #: pair of symbol numbers -> (rank, number of the merged symbol), packed in one int
        self._merge: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._merge.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._pieces = regex.compile(split["pattern"]["Regex"]).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self._special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
        self._chunks, self._words = Memo(), Memo()

    def piece(self, piece: str) -> int:
        """Tokens of one piece: symbols minus merges."""
        raw = piece.encode("utf-8")
        n = len(raw)
        if n == 1:
            return 1
        merge = self._merge.get
        first = self._first
        sym = [first[b] for b in raw]
        sym[-1] = self._last[raw[-1]]
        # A heap entry is rank << 32 | position of the pair's left symbol.
        heap, left, i = [], sym[0], 0
        for right in sym[1:]:
            hit = merge(left << 20 | right)
            if hit is not None:
                heap.append(hit >> 20 << 32 | i)
            left = right
            i += 1
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        sym.append(_GONE)
        count = n
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            hit = merge(sym[i] << 20 | sym[j])
            if hit is None or hit >> 20 != top >> 32:
                continue  # one of the two has been merged meanwhile
            sym[i] = new = hit & 0xFFFFF
            sym[j] = _GONE
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                hit = merge(new << 20 | sym[k])
                if hit is not None:
                    heappush(heap, hit >> 20 << 32 | i)
            h = before[i]
            if h >= 0:
                hit = merge(sym[h] << 20 | new)
                if hit is not None:
                    heappush(heap, hit >> 20 << 32 | h)
        return count

    def _chunk(self, chunk: str) -> int:
        total = self._chunks.old.get(chunk)
        if total is None:
            total, words = 0, self._words
            for piece in self._pieces(chunk):
                n = words.young.get(piece) or words.old.get(piece)
                if n is None:
                    n = self.piece(piece)
                words.keep(piece, n)
                total += n
        self._chunks.keep(chunk, total)
        return total

    def _plain(self, text: str) -> int:
        if not text.isascii():
            # Case folding is per character (no final sigma), after canonical composition.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        chunks = _SPACE.split(text) if _ODD_SPACE.search(text) else text.split()
        total, memo, miss = 0, self._chunks, self._chunk
        for chunk in chunks:
            n = memo.young.get(chunk)
            total += miss(chunk) if n is None else n
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        total = at = 0
        for m in self._special.finditer(text) if "<|" in text else ():
            total += self._plain(text[at:m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:] if at else text)


_COUNTERS: dict[str, MergeCounter] = {}


def _counter(path: str) -> MergeCounter:
    """One counter per worker process and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for every row of ``docs``.

    ``path`` names the BPE file on the workers (the public tokenizers package is installed
    there).  One narrow pass: no shuffle, one Arrow batch of texts in memory at a time.
    """
    ship(docs.sparkSession)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(path)
        for frame in frames:
            tokens = [counter.count(t) for t in frame["text"]]
            size = [len(t) if t.isascii() else len(t.encode("utf-8")) for t in frame["text"]]
            out = pd.DataFrame({"doc_id": frame["doc_id"], "n_bytes": size, "n_tokens": tokens})
            out["over_limit"] = out["n_tokens"] > limit
            yield out

    ids = docs.schema["doc_id"].dataType.simpleString()
    return id_and_text(docs).mapInPandas(
        count, f"doc_id {ids}, n_bytes long, n_tokens long, over_limit boolean")
