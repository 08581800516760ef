"""Silver -> gold star schema, driven by table specs.

A dimension is described by its business key; the fact by the dimensions it references.
The same code builds, numbers and merges every table:

* ``delta``: the slice reduced to one row per key, with ``_keyHash`` (business key) and
  ``_valueHash`` (what a change is detected on);
* ``merge_star``: hash-change merge into the current table; matched rows with a different
  value hash take the new control columns (and the measure, for the fact); new keys get
  identity values after the current maximum, in key order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestar import schemas as S
from lakestar.functions.hashing import COMPAT, EXACT, sha256_of
from lakestar.operators.dedup import newest_first_order
from lakestar.operators.keys import assign_sid, next_sid
from lakestar.operators.merging import merge
from lakestar.operators.quality import first_per_key
from lakestar.session import cut_lineage


@dataclass(frozen=True)
class TableSpec:
    name: str
    key: tuple[str, ...]          # business key (hashed into _keyHash)
    values: tuple[str, ...]       # hashed into _valueHash
    measures: tuple[str, ...]     # business columns that an update rewrites
    schema: T.StructType
    sid_alias: str | None = None  # name of the sid column when referenced by the fact

    @property
    def business(self) -> tuple[str, ...]:
        return self.key + self.measures

    @property
    def update_set(self) -> tuple[str, ...]:
        # Dimensions refresh the whole control block; the fact keeps its key hash.
        if self.measures:
            return self.measures + (S.RUN_ID, S.PROCESSING_DATE, S.VALUE_HASH)
        return (S.RUN_ID, S.PROCESSING_DATE, S.KEY_HASH, S.VALUE_HASH)


_RUN = (S.RUN_ID, S.PROCESSING_DATE)

DIM_NAMES = TableSpec("dim_names", ("first_name", "sex"), _RUN, (), S.DIM_NAMES_SCHEMA, "nameSid")
DIM_YEARS = TableSpec("dim_years", ("year",), _RUN, (), S.DIM_YEARS_SCHEMA, "yearSid")
DIM_LOCATIONS = TableSpec("dim_locations", ("county",), _RUN, (), S.DIM_LOCATIONS_SCHEMA,
                          "locationSid")
DIMS = (DIM_NAMES, DIM_YEARS, DIM_LOCATIONS)
FACT = TableSpec(
    "fact",
    ("nameSid", "yearSid", "locationSid"),
    ("count",) + _RUN,
    ("count",),
    S.FACT_SCHEMA,
)


def _with_hashes(df: DataFrame, spec: TableSpec, mode: str) -> DataFrame:
    return df.withColumns(
        {S.KEY_HASH: sha256_of(spec.key, mode), S.VALUE_HASH: sha256_of(spec.values, mode)}
    )


def delta(rows: DataFrame, spec: TableSpec, mode: str = EXACT) -> DataFrame:
    """One row per ``_keyHash`` of ``rows`` (newest control columns win).

    In the exact mode the hash is injective, so grouping by the business key is the same
    grouping; it is done on the key columns and the hashes are computed afterwards, on
    one row per key only.  The compat hash can collide, so there the hash is the group.
    """
    # _valueHash is a function of columns already in the order, so it is no tie-break.
    cols = list(spec.business) + list(_RUN)
    base = rows.select(*cols)
    if mode == EXACT:
        kept = first_per_key(base, spec.key, newest_first_order(cols, spec.key))
        return _with_hashes(kept, spec, mode)
    if mode == COMPAT:
        hashed = _with_hashes(base, spec, mode)
        return first_per_key(hashed, [S.KEY_HASH], newest_first_order(cols, [S.KEY_HASH]))
    raise ValueError(mode)


def _member_columns(specs: Sequence[TableSpec]) -> list[str]:
    return list(dict.fromkeys(c for spec in specs for c in spec.key))


def dimension_members(rows: DataFrame, specs: Sequence[TableSpec] = DIMS) -> DataFrame:
    """One row per member of every dimension, with its newest ``(date, run)`` and the
    grouping id telling which dimension it belongs to (one GROUPING SETS aggregation)."""
    newest = F.max(F.struct(F.col(S.PROCESSING_DATE).alias("d"), F.col(S.RUN_ID).alias("r")))
    return rows.groupingSets([list(spec.key) for spec in specs], *_member_columns(specs)).agg(
        F.grouping_id().alias("__gid"), newest.alias("__newest"))


def dimension_deltas(rows: DataFrame, specs: Sequence[TableSpec] = DIMS) -> dict[str, DataFrame]:
    """Every dimension's delta from one scan and one shuffle (exact hash mode).

    GROUPING SETS over the dimensions' business keys: each row is expanded once per
    dimension, aggregated partially, shuffled once.  Per key the newest
    ``(processing date, run id)`` wins — ``max`` over the struct orders the same way as the
    per-dimension window (date, then run, both descending, NULL lowest), and the
    dimensions carry no other column, so the rows kept are the same as :func:`delta`'s.
    The aggregate (one row per dimension member) is materialised once; each dimension's
    delta reads it, so the slice is scanned once rather than once per dimension.
    """
    cols = _member_columns(specs)
    grouped = cut_lineage(dimension_members(rows, specs))
    out = {}
    for spec in specs:
        # grouping_id: one bit per grouping column, set when the column is rolled up.
        gid = sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in spec.key)
        kept = grouped.filter(F.col("__gid") == gid).select(
            *spec.key,
            F.col("__newest.r").alias(S.RUN_ID),
            F.col("__newest.d").alias(S.PROCESSING_DATE),
        )
        out[spec.name] = _with_hashes(kept, spec, EXACT)
    return out


def source_rows(rows: DataFrame, spec: TableSpec, mode: str = EXACT) -> DataFrame:
    """Every row of the slice as a gold source row, with hashes (before de-duplication)."""
    return _with_hashes(rows.select(*spec.business, *_RUN), spec, mode)


def unmatched(source: DataFrame, target: DataFrame, on: Sequence[str],
              target_buckets: int | None = None) -> DataFrame:
    """Source rows whose key is absent from the target (an anti-join).

    A target bucketed on the key is read in place; only the source is hash-partitioned.
    """
    keys = list(on)
    if target_buckets:
        source = source.repartition(int(target_buckets), *keys)
    return source.join(target.select(*keys), keys, "left_anti")


def merge_star(
    target: DataFrame | None,
    source: DataFrame,
    spec: TableSpec,
    target_buckets: int | None = None,
    start: int | None = None,
    materialised: bool = False,
) -> DataFrame:
    """New content of a gold table after merging a de-duplicated ``source`` (a delta).

    The delta is materialised once in the shared checkpoint folder (unless it is already): the
    key lookup and the merge both read it instead of recomputing the slice.  Only the keys of the
    unmatched rows are numbered, the measures do not travel through the range sort.  New ids
    begin at ``start`` (default: after the target's greatest); a target that is only the part of
    a table that the source's keys fall into needs it.
    """
    out_cols = [f.name for f in spec.schema.fields]
    order = [F.col(c).asc_nulls_first() for c in spec.key] + [F.col(S.KEY_HASH).asc_nulls_first()]
    src = source.select(*[c for c in out_cols if c != S.SID])
    if not materialised:
        src = cut_lineage(src)
    if start is None:
        start = next_sid(target)
    if target is None:
        return _conform(assign_sid(src, order, start=start), spec.schema)
    new_keys = unmatched(src.select(*spec.key, S.KEY_HASH), target, [S.KEY_HASH],
                         target_buckets=target_buckets)
    sids = assign_sid(new_keys, order, start=start).select(S.KEY_HASH, S.SID)
    src = src.join(sids, S.KEY_HASH, "left")
    merged = merge(
        target,
        src,
        [S.KEY_HASH],
        update_when=lambda t, s: s(S.VALUE_HASH) != t(S.VALUE_HASH),
        update_set=list(spec.update_set),
        insert_values=out_cols,
        check_unique=False,  # the delta is one row per key by construction
        target_buckets=target_buckets,
    )
    return _conform(merged, spec.schema)


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def lookup_sids(
    rows: DataFrame,
    dims: Mapping[str, DataFrame],
    specs: Sequence[TableSpec] = DIMS,
    unknown: int | None = S.UNKNOWN_SID,
) -> DataFrame:
    """Left-join each dimension on its business key and add its sid as ``sid_alias``.

    A missing member gets ``unknown`` (-1).  The planner broadcasts a dimension whose measured
    size allows it; a larger one joins by shuffle, where AQE splits a popular member's rows.
    """
    out = rows
    for spec in specs:
        d = dims[spec.name].select(*spec.key, F.col(S.SID).alias(spec.sid_alias))
        out = out.join(d, list(spec.key), "left")
        if unknown is not None:
            out = out.withColumn(
                spec.sid_alias, F.coalesce(F.col(spec.sid_alias), F.lit(unknown).cast("long"))
            )
    return out


def fact_rows(rows: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """Silver rows as fact rows: the three SIDs, the measure and the run columns."""
    return lookup_sids(rows, dims).select(*FACT.key, *FACT.measures, *_RUN)
