"""DataFrame -> DataFrame operators of the pipeline."""

from lakestar.operators.dedup import distinct_rows, one_per_key, one_per_sid
from lakestar.operators.keys import assign_sid, next_sid
from lakestar.operators.maintenance import compacted
from lakestar.operators.mart import (
    fk_orphans,
    mart_copy,
    mart_source,
    pk_violations,
    upsert,
    with_unknown_member,
)
from lakestar.operators.merging import ambiguous_keys, check_unique_keys, merge, merge_metrics
from lakestar.operators.quality import (
    clean,
    latest_per_key,
    quality_filter,
    quarantine,
    quarantine_reason,
    rename_measure,
)
from lakestar.operators.star import DIMS, FACT, delta, lookup_sids, merge_star

__all__ = [
    "DIMS",
    "FACT",
    "ambiguous_keys",
    "assign_sid",
    "check_unique_keys",
    "clean",
    "compacted",
    "delta",
    "distinct_rows",
    "fk_orphans",
    "latest_per_key",
    "lookup_sids",
    "mart_copy",
    "mart_source",
    "merge",
    "merge_metrics",
    "merge_star",
    "next_sid",
    "one_per_key",
    "one_per_sid",
    "pk_violations",
    "quality_filter",
    "quarantine",
    "quarantine_reason",
    "rename_measure",
    "upsert",
    "with_unknown_member",
]
