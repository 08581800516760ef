"""Spelling variants: words that one edit turns into each other, by permuterm rotations.

A word is marked with a terminator and rotated.  Rotated so that an edited character comes
last, the word begins with everything but that character; so the words that a replacement or
an indel at one place turns into each other share a prefix:

* a word's rotation *without its last character* (skipped: every place in turn),
* and, for the shorter side of an indel, a word's *whole* rotation (every place in turn).

Sorted by that prefix, the words of a group stand together: at most one whole rotation, and one
skipped rotation for each letter of the alphabet.  A scan of the sorted group gives every member
its neighbour of largest count and its number of neighbours, without listing the pairs:

* two words differ by a replacement at one place only, so each skipped rotation counts the
  other skipped ones of its group;
* removing any letter of a stretch of equal letters gives the same word, so an indel counts in
  the group that skips the first letter of the stretch, and in no other.

Groups are bounded by the alphabet, whatever the corpus.  The prefixes of
a very long word would be of quadratic size in all; those of more than ``SPELLED`` code points
stand as 127-bit polynomial hashes (with lengths) instead, computed in linear time.

Defined cases: null and empty texts have no words; a null id counts as empty text where ids are
hashed; repeated rows each count; a word without neighbours is its own root; ties of count go
to the smallest word in code-point order; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakestar.llm.common import batches, ship, stored
from lakestar.operators.keys import assign_sid

#: Words have at least so many code points and occurrences; a form is so many times as frequent.
LEAST_LETTERS, LEAST_COUNT, FORM_RATIO = 6, 5, 5
TERMINATOR = "$"
#: Code points up to which prefixes stand as they are; beyond, as polynomial hashes.
SPELLED = 64
#: Counts or prefixes that a task holds before it passes them on.
HELD = 100_000

#: Lower-case ASCII letters and U+00C0 to U+00FF, as UTF-8.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_PRIME, _BASE = (1 << 127) - 1, 0x5DEECE66D1234567890ABCDEF

#: For a row's id (as text) and a word: the word to count in its place.
Edit = Callable[[bytes], Callable[[bytes], bytes]]


def count_words(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """word, n: the frequent words of all texts, lower-cased in ASCII.

    ``edit``, given a row's id as text, gives the function that every word of it goes through.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text"
                       ).where("text is not null")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame({"word": [w.decode() for w in held], "n": list(held.values())})

        for part in batches(frames, 64):
            for doc_id, text in zip(part["id"], part["text"], strict=True):
                # Bytes are lower-cased in ASCII only.
                found = Counter(_RUN.findall(text.encode("utf-8", "replace").lower()))
                change = edit(doc_id.encode()) if edit else None
                for word, n in found.items():
                    if len(word) < LEAST_LETTERS:
                        continue
                    if change:
                        word = change(word)
                    if len(word) - word.count(b"\xc3") >= LEAST_LETTERS:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return (rows.mapInPandas(run, "word string, n long").groupBy("word")
            .agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT))


def rotations(word: str) -> Iterator[tuple[str, bool, bool]]:
    """(prefix, skipped, first): the prefixes under which a word is sorted.

    ``first``: the skipped letter begins a stretch of equal letters.
    """
    size = len(word)
    sums, powers = [0], [1]
    if size > SPELLED:
        for letter in word:
            sums.append((sums[-1] * _BASE + ord(letter)) % _PRIME)
            powers.append(powers[-1] * _BASE % _PRIME)

    def prefix(after: int, before: int) -> str:
        if size - after + before <= SPELLED:
            return word[after:] + TERMINATOR + word[:before]
        tail = sums[-1] - sums[after] * powers[size - after]
        value = (tail * _BASE + ord(TERMINATOR)) * powers[before] + sums[before]
        # Length and place of the terminator are part of the prefix.
        return f"{TERMINATOR}{size - after + before}:{before}:{value % _PRIME:032x}"

    for at in range(size):
        yield prefix(at + 1, at), True, at == 0 or word[at] != word[at - 1]
    for at in range(size + 1):
        yield prefix(at, at), False, False


def _rotated(words: DataFrame) -> DataFrame:
    """prefix, skipped, first, id, n: every word (id, word, n) under all its prefixes.

    The word itself stays behind: a long one has as many prefixes as letters.
    """
    columns = ["prefix", "skipped", "first", "id", "n"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for part in frames:
            for key, word, n in zip(part["id"], part["word"], part["n"], strict=True):
                for rotation in rotations(word):
                    rows.append((*rotation, key, n))
                    if len(rows) == HELD:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return words.mapInPandas(run, "prefix string, skipped boolean, first boolean, id long, n long")


def neighbours(words: DataFrame) -> DataFrame:
    """id, n_near, near, near_n of the words (id, word, n; ids in order of the words) that have a
    neighbour: their number, and the one of largest count (ties: the smallest)."""
    group = Window.partitionBy("prefix")
    # The whole rotation stands last, the skipped ones before it by count.
    scan = group.orderBy(F.col("skipped").desc(), F.col("n").desc(), "id")
    all_rows = scan.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    member = F.struct((-F.col("n")).alias("less"), "id", "skipped")
    seen = _rotated(words).select(
        "id", "skipped", "first", F.row_number().over(scan).alias("place"),
        F.first(member).over(all_rows).alias("one"), F.nth_value(member, 2).over(all_rows).alias("two"),
        F.last(member).over(all_rows).alias("end"),
        F.count_if("skipped").over(group).alias("n_skipped"),
        F.count_if("first").over(group).alias("n_first"),
        F.count(F.lit(1)).over(group).alias("size")).where("size > 1")
    # A skipped member is near all others, the whole one is near the skipped ones: for either,
    # the best is among the first two of the scan and the last (only a whole one may stand out).
    whole = ~F.col("end.skipped")
    best_skipped = F.when(F.col("place") == 1, F.when(F.col("two.skipped"), F.col("two"))).otherwise(
        F.when(F.col("one.skipped"), F.col("one")))
    best = F.least(best_skipped, F.when(F.col("skipped") & whole, F.col("end")))
    count = F.when(F.col("skipped"), F.col("n_skipped") - 1
                   + F.when(F.col("first") & whole, 1).otherwise(0)).otherwise(F.col("n_first"))
    return (seen.select("id", count.alias("count"), best.alias("best")).groupBy("id")
            .agg(F.sum("count").alias("n_near"), F.min("best").alias("best"))
            .select("id", "n_near", F.col("best.id").alias("near"), (-F.col("best.less")).alias("near_n")))


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """id, root of the words (id, form): forms followed to the last.

    ``longest`` bounds the steps of any chain; each round doubles the steps taken.
    """
    reached = stored(forms.select("id", F.col("form").alias("root")), "variants")
    taken = 1
    while taken < longest:
        onward = reached.select(F.col("id").alias("root"), F.col("root").alias("further"))
        reached = stored(reached.join(onward, "root", "left").select(
            "id", F.coalesce("further", "root").alias("root")), "variants")
        taken *= 2
    return reached


def longest_chain(most: int) -> int:
    """Steps that forms can go on for when no word occurs more than ``most`` times: each is
    ``FORM_RATIO`` times as frequent as the one before."""
    steps, n = 0, LEAST_COUNT
    while n * FORM_RATIO <= most:
        n, steps = n * FORM_RATIO, steps + 1
    return steps


def variants(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word of all texts.

    Words go through the joins as numbers in their order.
    """
    words = stored(assign_sid(count_words(docs, edit), ["word"], sid_col="id"), "variants")
    near = words.select("id", "n").join(neighbours(words), "id", "left")
    frequent = F.col("near_n") >= FORM_RATIO * F.col("n")
    found = stored(near.select(
        "id", F.when(frequent, F.col("near")).alias("form"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("near_n")).alias("form_n")), "variants")
    most = words.agg(F.max("n")).first()[0] or 0
    formed = found.where("form is not null")
    last = roots(formed.select("id", "form"), longest_chain(most))
    name = words.select(F.col("id").alias("of"), F.col("word").alias("name"))
    # Only words that have a form look up names.
    named = (formed.select("id", "form").join(last, "id")
             .join(name.withColumnsRenamed({"of": "form", "name": "form_word"}), "form")
             .join(name.withColumnsRenamed({"of": "root", "name": "root_word"}), "root")
             .select("id", "form_word", "root_word"))
    return words.join(found.select("id", "n_near", "form_n"), "id").join(named, "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"),
        "n", "n_near", "form_n")


#: One in so many words of a document loses a code point.
SLIP = 199


def slips(doc_id: bytes) -> Callable[[bytes], bytes]:
    """Words that lose a code point, told by the hash of id and word."""
    before = zlib.crc32(doc_id + b":")

    def change(word: bytes) -> bytes:
        h = zlib.crc32(word, before)
        if h % SLIP:
            return word
        letters = word.decode()
        at = h % len(letters)
        return (letters[:at] + letters[at + 1:]).encode()

    return change


def oracle() -> str:
    """DuckDB SQL of :func:`variants` over ``documents`` with :func:`slips`."""
    return rf"""
with recursive
crc as (
    select list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8],
                            lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) order by i) as t
    from range(256) r(i)),
found as (
    select coalesce(cast(doc_id as varchar), '') as id, translate(
        unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
    from documents),
runs as (
    select run, count(*) as n, hex(encode(id || ':' || run)) as x
    from found where length(run) >= {LEAST_LETTERS} group by id, run),
hashed as (
    select run, n, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(range(length(x) // 2),
            lambda i: (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16
                      + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h
    from runs, crc),
edited as (
    select case when h % {SLIP} = 0
                then left(run, cast(h % length(run) as bigint))
                     || substr(run, cast(h % length(run) as bigint) + 2)
                else run end as word, n
    from hashed),
words as materialized (
    select word, cast(sum(n) as bigint) as n from edited
    where length(word) >= {LEAST_LETTERS} group by word having sum(n) >= {LEAST_COUNT}),
cut as materialized (
    select word, n, i, left(word, i) || substr(word, i + 2) as rest
    from (select word, n, unnest(range(length(word))) as i from words)),
near as (
    select a.word, b.word as other, b.n as other_n
    from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
    union select a.word, b.word, b.n from cut a join words b on a.rest = b.word
    union select b.word, a.word, a.n from cut a join words b on a.rest = b.word),
best as (
    select word, count(*) as n_near, first(other order by other_n desc, other) as near,
           max(other_n) as near_n
    from near group by word),
formed as materialized (
    select word, n, coalesce(n_near, 0) as n_near,
           case when near_n >= {FORM_RATIO} * n then near end as form,
           case when near_n >= {FORM_RATIO} * n then near_n end as form_n
    from words left join best using (word)),
chain as (
    select word, word as at, form as next from formed
    union all
    select c.word, f.word, f.form from chain c join formed f on f.word = c.next)
select f.word, f.form, c.at as root, f.n, f.n_near, f.form_n
from formed f join chain c on c.word = f.word and c.next is null
"""
