"""Rows and helpers that the tests of this folder share."""

from __future__ import annotations

DATA = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "score string, bucket string, row string, key string, task string")


def make(spark, rows):
    """Documents (doc_id, text, lang) with extra columns whose names operators use inside."""
    return spark.createDataFrame(
        [(i, t, a, "s", None if t is None else len(t), "x", "x", "x", None, "x")
         for i, t, a in rows], SCHEMA)


LONG = ("the quick fox and the dog went on over there. " * 6000).strip()
#: Null and empty texts, junk, a very long text, a repeated row, equal texts, a null id.
EDGES = [(1, None, None), (2, "", "en"), (3, "!!! 123", None), (4, LONG, "en"),
         (5, "one two three", "en"), (5, "one two three", "en"), (6, "one two three", None),
         (None, "one two three four five six", "en"), (7, "\n\n  \n", "fr"), (8, "é 中文 😀", "fr")]
