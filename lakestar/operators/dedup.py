"""One row per key (gold sources, mart sources) and distinct rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestar import schemas as S
from lakestar.operators.quality import first_per_key


def newest_first_order(columns: Sequence[str], key: Sequence[str]) -> list[Column]:
    """Latest processing date, then latest run id, then every other column ascending.

    Replaces an arbitrary ``first()`` per key with a total order, so the kept row is the
    same on every run and every plan.
    """
    lead = [F.col(S.PROCESSING_DATE).desc_nulls_last(), F.col(S.RUN_ID).desc_nulls_last()]
    used = set(key) | {S.PROCESSING_DATE, S.RUN_ID}
    return lead + [F.col(c).asc_nulls_first() for c in columns if c not in used]


def one_per_key(df: DataFrame, key: Sequence[str] = (S.KEY_HASH,)) -> DataFrame:
    """Reduce a gold source to one row per key (newest control columns win)."""
    return first_per_key(df, key, newest_first_order(df.columns, key))


def distinct_rows(df: DataFrame) -> DataFrame:
    """Distinct over all columns (partial aggregation before the shuffle)."""
    return df.distinct()


def one_per_sid(df: DataFrame, sid_col: str = S.SID, newest: str = S.PROCESSING_DATE) -> DataFrame:
    """One row per ``sid``: the newest version (then all columns ascending as tie-break)."""
    order = [F.col(newest).desc_nulls_last()] + [
        F.col(c).asc_nulls_first() for c in df.columns if c not in (sid_col, newest)
    ]
    return first_per_key(df, [sid_col], order)
