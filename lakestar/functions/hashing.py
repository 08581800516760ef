"""Key and value hashes of gold rows (SHA-256, hex).

Two encodings of the hashed columns:

* ``"exact"`` (default): every part is written as ``<length>:<text>`` and NULL as ``N``;
  parts are joined with ``|``.  The encoding is injective, so distinct column tuples never
  share an input string (SIDs ``(1, 11, 1)`` and ``(11, 1, 1)`` stay apart) and NULLs
  are hashed instead of nulling the whole hash.
* ``"compat"``: plain concatenation without separator, NULL when any part is NULL.  Kept to
  reproduce and measure the collisions of the unseparated form.

All parts are cast to string explicitly, so the result does not depend on implicit
coercion rules.  Timestamps are hashed as their string form (``yyyy-MM-dd HH:mm:ss``);
use ``timestamp_ntz`` columns or a UTC session so that form does not depend on the zone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "exact"
COMPAT = "compat"


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode_part(c: str | Column) -> Column:
    """``<length>:<text>`` for a value, ``N`` for NULL."""
    text = _as_col(c).cast("string")
    return F.when(text.isNull(), F.lit("N")).otherwise(
        F.concat(F.length(text).cast("string"), F.lit(":"), text)
    )


def hash_input(cols: Sequence[str | Column], mode: str = EXACT) -> Column:
    """The string that is hashed for ``cols``."""
    if mode == EXACT:
        return F.concat_ws("|", *[encode_part(c) for c in cols])
    if mode == COMPAT:
        return F.concat(*[_as_col(c).cast("string") for c in cols])
    raise ValueError(f"unknown hash mode {mode!r}")


def sha256_of(cols: Sequence[str | Column], mode: str = EXACT) -> Column:
    """SHA-256 hex digest of the encoded columns."""
    return F.sha2(hash_input(cols, mode), 256)
