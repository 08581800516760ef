"""Bronze -> silver cleaning: rename, quality rule, latest row per key, quarantine."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestar import schemas as S


def rename_measure(df: DataFrame, old: str = S.MEASURE_RAW, new: str = S.MEASURE) -> DataFrame:
    """Rename the measure; fail loudly when it is missing (a silent no-op hides drift)."""
    if old not in df.columns:
        raise ValueError(f"column {old!r} not found; columns are {df.columns}")
    return df.withColumnRenamed(old, new)


def quality_rule(
    required: Sequence[str] = S.REQUIRED_COLUMNS,
    positive: Sequence[str] = S.POSITIVE_COLUMNS,
) -> Column:
    """All ``required`` columns present and all ``positive`` columns > 0."""
    checks = [F.col(c).isNotNull() for c in required] + [F.col(c) > 0 for c in positive]
    return reduce(lambda a, b: a & b, checks)


def quality_filter(df: DataFrame, rule: Column | None = None) -> DataFrame:
    """Rows that pass the quality rule (NULL outcome counts as a failure)."""
    r = quality_rule() if rule is None else rule
    return df.filter(F.coalesce(r, F.lit(False)))


def latest_order(columns: Sequence[str], keys: Sequence[str]) -> list[Column]:
    """Newest file first, then the smaller measure, then every other column as tie-break.

    The tie-break makes the order total, so the kept row never depends on the plan.
    """
    lead = [F.col(S.INPUT_MODIFIED).desc_nulls_last(), F.col(S.MEASURE).asc_nulls_first()]
    used = set(keys) | {S.INPUT_MODIFIED, S.MEASURE}
    rest = [
        F.col(c).desc_nulls_last() if c == S.PROCESSING_DATE else F.col(c).asc_nulls_first()
        for c in columns
        if c not in used
    ]
    return lead + rest


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``.

    ``row_number() = 1`` lets Catalyst insert a partial ``WindowGroupLimit`` before the
    shuffle, so each map task forwards at most one row per key: a key that holds a large
    share of the rows is cut down before it reaches a single reducer.
    """
    rn = "__rn"
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) == 1).drop(rn)


def best_per_lineage(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the rows of a key that differ only in file time and measure, the first in ``latest_order``.

    Hash aggregation, partial ahead of the shuffle, without a sort of the rows: it holds numbers
    only, so both are put into one, ``time in microseconds * 10^10 - measure`` (a measure has at
    most 10 digits), whose maximum is the newest time's smallest measure.  NULLs are kept apart.
    """
    place, no_time, no_measure = "__place", "__no_time", "__no_measure"
    rest = [c for c in df.columns if c not in (*keys, S.INPUT_MODIFIED, S.MEASURE)]
    time, measure = F.col(S.INPUT_MODIFIED), F.col(S.MEASURE)

    def steps(ts: Column) -> Column:
        since = (ts - F.lit("1970-01-01").cast("timestamp_ntz")).cast("interval second")
        micros = (since.cast("decimal(20,6)") * F.lit(1_000_000)).cast("decimal(19,0)")
        return F.coalesce(micros, F.lit(0)) * F.lit(10**10).cast("decimal(11,0)")

    best = df.groupBy(
        *keys, *rest, time.isNull().alias(no_time), measure.isNull().alias(no_measure)
    ).agg(
        F.max(time).alias(S.INPUT_MODIFIED),
        F.max(steps(time) - F.coalesce(measure, F.lit(0)).cast("decimal(10,0)")).alias(place),
    )
    least = F.when(~F.col(no_measure), (steps(time) - F.col(place)).cast("int"))
    return best.withColumn(S.MEASURE, least).select(*df.columns)


def latest_per_key(df: DataFrame, keys: Sequence[str] = S.NATURAL_KEY) -> DataFrame:
    """Latest row per natural key (newest file, then smallest measure)."""
    if (df.schema[S.INPUT_MODIFIED].dataType, df.schema[S.MEASURE].dataType) == (
            T.TimestampNTZType(), T.IntegerType()):
        df = best_per_lineage(df, keys)
    return first_per_key(df, keys, latest_order(df.columns, keys))


def quarantine(slice_df: DataFrame, survivors: DataFrame) -> DataFrame:
    """Every distinct slice row that is not a survivor (EXCEPT DISTINCT, NULL-safe).

    Exact copies collapse to one row, and a copy equal to the kept row disappears.  Both sides
    are grouped together, so NULLs compare as equal, and the partial aggregation collapses
    copies before the only shuffle: a group of identical rows never reaches a task whole.
    """
    cols = slice_df.columns
    kept = "__kept"
    both = slice_df.withColumn(kept, F.lit(0)).unionByName(
        survivors.select(*cols).withColumn(kept, F.lit(1)))
    return both.groupBy(*cols).agg(F.max(kept).alias(kept)).where(F.col(kept) == 0).select(*cols)


def quarantine_reason(errors: DataFrame, rule: Column | None = None) -> DataFrame:
    """Adds ``reason``: ``invalid`` (failed the rule) or ``superseded`` (lost to a newer row)."""
    r = quality_rule() if rule is None else rule
    return errors.withColumn(
        "reason", F.when(F.coalesce(r, F.lit(False)), F.lit("superseded")).otherwise("invalid")
    )


def clean(slice_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a renamed slice into (survivors, errors)."""
    survivors = latest_per_key(quality_filter(slice_df))
    return survivors, quarantine(slice_df, survivors)
