"""Generic upsert of a source frame into a target frame (MERGE without a table format).

``merge`` returns the *new content* of the target: every target row (updated or carried
over) plus the inserted source rows.  Keys match with plain ``=`` (a NULL key never
matches), and a NULL update guard means "no update".

One physical shape at every size: a full-outer equi-join.  Both sides are hash-partitioned on
the key; keys are unique on both sides (the source is checked or de-duplicated by
construction), so the join has no hot key, and it spills instead of failing.

``target_buckets``: the target is read hash-bucketed on the key into that many buckets
(see ``lakestar.sources.tables.Bucketing``).  Only the source is then hash-partitioned, into
the same buckets, and the sort-merge join reads the target in place.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Side = Callable[[str], Column]
Guard = Callable[[Side, Side], Column]
Value = Callable[[Side, Side], Column]

ACTION = "_action"
INSERT, UPDATE, UNCHANGED, CARRIED = "insert", "update", "unchanged", "carried"

_T, _S = "__t", "__s"


def _tcol(c: str) -> Column:
    return F.col(_T)[c]


def _scol(c: str) -> Column:
    return F.col(_S)[c]


def _as_values(spec: Mapping[str, Value | str | None] | Sequence[str] | None) -> dict:
    if spec is None:
        return {}
    if isinstance(spec, Mapping):
        out = {}
        for k, v in spec.items():
            if v is None:
                out[k] = None
            elif isinstance(v, str):
                out[k] = (lambda name: (lambda t, s: s(name)))(v)
            else:
                out[k] = v
        return out
    return {c: (lambda name: (lambda t, s: s(name)))(c) for c in spec}


def ambiguous_keys(source: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that occur more than once in the source (NULL keys never match, so skipped)."""
    not_null = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on])
    return (
        source.filter(not_null)
        .groupBy(*on)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .filter(F.col("n_rows") > 1)
    )


def check_unique_keys(source: DataFrame, on: Sequence[str]) -> None:
    """Fail when a source key repeats: one target row cannot take two updates."""
    if not ambiguous_keys(source, on).isEmpty():
        raise ValueError(
            f"merge source has repeated keys on {list(on)}; reduce it to one row per key first"
        )


def merge(
    target: DataFrame | None,
    source: DataFrame,
    on: Sequence[str],
    *,
    update_when: Guard | None = None,
    update_set: Mapping[str, Value | str] | Sequence[str] | None = None,
    insert_values: Mapping[str, Value | str | None] | Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
    check_unique: bool = True,
    with_action: bool = False,
    target_buckets: int | None = None,
) -> DataFrame:
    """New target content after merging ``source`` on key columns ``on``.

    ``update_when(t, s)``: guard of a matched row (default: always).  ``update_set``: target
    columns that take a new value on update (names copy the source column of the same
    name).  ``insert_values``: value of each target column for an inserted row (default:
    the source column of the same name; ``None`` -> NULL).  ``columns``: output columns
    when there is no target yet (first load).
    """
    if check_unique:
        check_unique_keys(source, on)
    out_cols = list(target.columns if target is not None else (columns or source.columns))
    types = (
        {f.name: f.dataType for f in target.schema.fields}
        if target is not None
        else {f.name: f.dataType for f in source.schema.fields}
    )
    upd = _as_values(update_set)
    ins = _as_values(insert_values) if insert_values is not None else _as_values(
        [c for c in out_cols if c in source.columns]
    )
    guard = update_when or (lambda t, s: F.lit(True))

    s = source.select(*[F.col(k).alias(f"__j{i}") for i, k in enumerate(on)],
                      F.struct(*source.columns).alias(_S))
    if target is None:
        # First load: every source row is an insert.
        def first(c: str) -> Column:
            e = ins.get(c)
            v = F.lit(None) if e is None else e(_tcol, _scol)
            return (v.cast(types[c]) if c in types else v).alias(c)

        extra = [F.lit(INSERT).alias(ACTION)] if with_action else []
        return s.select(*[first(c) for c in out_cols], *extra)

    t = target.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(on)],
                      F.struct(*target.columns).alias(_T))
    if target_buckets:
        s = s.repartition(int(target_buckets), *[f"__j{i}" for i in range(len(on))])
    same = reduce(lambda a, b: a & b, [t[f"__k{i}"] == s[f"__j{i}"] for i in range(len(on))])
    joined = t.join(s, same, "full_outer")
    has_t = F.col(_T).isNotNull()
    has_s = F.col(_S).isNotNull()

    matched = has_t & has_s
    action = (
        F.when(matched & F.coalesce(guard(_tcol, _scol), F.lit(False)), F.lit(UPDATE))
        .when(matched, F.lit(UNCHANGED))
        .when(has_t, F.lit(CARRIED))
        .otherwise(F.lit(INSERT))
    )
    staged = joined.withColumn(ACTION, action)

    def project(c: str) -> Column:
        dtype = types.get(c)
        ins_expr = ins.get(c)
        ins_val = F.lit(None) if ins_expr is None else ins_expr(_tcol, _scol)
        expr = F.when(F.col(ACTION) == INSERT, ins_val.cast(dtype))
        if c in upd:
            expr = expr.when(F.col(ACTION) == UPDATE, upd[c](_tcol, _scol).cast(dtype))
        return expr.otherwise(_tcol(c)).alias(c)

    extra = [F.col(ACTION)] if with_action else []
    return staged.select(*[project(c) for c in out_cols], *extra)


def merge_metrics(merged: DataFrame) -> DataFrame:
    """One row of action counts of a merge result produced with ``with_action=True``."""
    a = F.col(ACTION)
    return merged.agg(
        F.count_if(a == INSERT).alias("inserted"),
        F.count_if(a == UPDATE).alias("updated"),
        F.count_if(a == UNCHANGED).alias("unchanged"),
        F.count_if(a == CARRIED).alias("carried"),
        F.count(F.lit(1)).alias("rows_out"),
    )


__all__ = [
    "ACTION",
    "CARRIED",
    "INSERT",
    "UNCHANGED",
    "UPDATE",
    "ambiguous_keys",
    "check_unique_keys",
    "merge",
    "merge_metrics",
]
