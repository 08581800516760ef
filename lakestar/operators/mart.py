"""Gold -> reporting mart: typed copy, source de-duplication, upsert by sid, key checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestar import schemas as S
from lakestar.functions.casting import Mapping as ColumnMapping
from lakestar.functions.casting import copy_mapped
from lakestar.operators.dedup import distinct_rows, one_per_sid
from lakestar.operators.merging import merge

MAPPINGS: dict[str, ColumnMapping] = {
    "dim_names": S.MART_DIM_NAMES,
    "dim_years": S.MART_DIM_YEARS,
    "dim_locations": S.MART_DIM_LOCATIONS,
    "fact": S.MART_FACT,
}


def mart_copy(gold: DataFrame, table: str) -> DataFrame:
    """Typed, column-mapped copy of a gold table (control columns dropped)."""
    return copy_mapped(gold, MAPPINGS[table])


def mart_source(gold_versions: DataFrame, table: str, dedup: str = "rownum") -> DataFrame:
    """One row per sid, ready for :func:`upsert`.

    ``rownum``: the newest version of each sid (by ``_processing_date``), chosen before the
    copy drops that column.  ``distinct``: distinct rows after the copy (a sid with two
    different versions then stays ambiguous and the upsert refuses it).
    """
    if dedup == "rownum":
        return mart_copy(one_per_sid(gold_versions), table)
    if dedup == "distinct":
        return distinct_rows(mart_copy(gold_versions, table))
    raise ValueError(dedup)


def upsert(target: DataFrame | None, source: DataFrame, on: Sequence[str] = (S.SID,),
           check_unique: bool = True,
           target_buckets: int | None = None, with_action: bool = False) -> DataFrame:
    """Matched sid -> overwrite the business columns; new sid -> insert; nothing deleted.

    A sid that repeats in the source fails the upsert (``check_unique``), unless the
    caller reduced the source to one row per sid (:func:`mart_source` does).
    """
    business = [c for c in source.columns if c not in on]
    return merge(
        target,
        source,
        list(on),
        update_set=business,
        insert_values=source.columns,
        columns=source.columns,
        check_unique=check_unique,
        target_buckets=target_buckets,
        with_action=with_action,
    )


def unknown_member_row(dim: DataFrame, sid_col: str = S.SID) -> DataFrame:
    """One row shaped like ``dim``: ``sid = -1``, every attribute NULL."""
    return dim.sparkSession.range(1).select(
        *[
            (F.lit(S.UNKNOWN_SID) if c == sid_col else F.lit(None))
            .cast(dim.schema[c].dataType).alias(c)
            for c in dim.columns
        ]
    )


def with_unknown_member(dim: DataFrame, sid_col: str = S.SID) -> DataFrame:
    """Adds the ``sid = -1`` member (NULL attributes) unless the dimension has one."""
    present = dim.filter(F.col(sid_col) == S.UNKNOWN_SID).select(sid_col)
    return dim.unionByName(unknown_member_row(dim, sid_col).join(present, sid_col, "left_anti"))


def fk_orphans(
    fact: DataFrame,
    dims: Mapping[str, DataFrame],
    foreign_keys: Sequence[tuple[str, str]] = S.MART_FOREIGN_KEYS,
    sid_col: str = S.SID,
) -> DataFrame:
    """Per foreign key: the number of fact rows whose value has no row in the dimension.

    A NULL value passes, as in a foreign-key constraint.

    One scan and one aggregation for all foreign keys (grouping sets, partial first): it leaves
    (value, rows) per foreign-key value, so a hot value (say the unknown member) is collapsed
    before any shuffle, and only distinct values meet the dimensions.
    """
    columns = [fk for fk, _ in foreign_keys]
    counted = fact.groupingSets([[fk] for fk in columns], *columns).agg(
        F.grouping_id().alias("__gid"), F.count(F.lit(1)).alias("n"))
    parts = []
    for at, (fk, table) in enumerate(foreign_keys):
        # grouping_id: one bit per grouping column, set when the column is rolled up.
        gid = (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - at))
        per_value = counted.where((F.col("__gid") == gid) & F.col(fk).isNotNull()).select(fk, "n")
        d = dims[table].select(F.col(sid_col).alias(fk)).distinct()
        orphans = per_value.join(d, fk, "left_anti")
        parts.append(
            orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("orphan_rows")).select(
                F.lit(fk).alias("fk_column"), F.lit(table).alias("dim_table"), "orphan_rows"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def pk_violations(df: DataFrame, key: Sequence[str] = (S.SID,)) -> DataFrame:
    """Key values that occur more than once, with their row count."""
    return (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .filter(F.col("n_rows") > 1)
    )
