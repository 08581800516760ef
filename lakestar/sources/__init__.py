"""Sources and sinks at the edges of the pipeline."""

from lakestar.sources.feed import names_feed, read_table
from lakestar.sources.files import (
    read_landing,
    read_modified_since,
    with_audit,
    with_file_lineage,
    write_landing,
)
from lakestar.sources.tables import (
    append_by_day,
    day_slice,
    read_log,
    read_log_day,
    read_snapshot,
    snapshot_path,
    write_snapshot,
)

__all__ = [
    "append_by_day",
    "day_slice",
    "names_feed",
    "read_landing",
    "read_log",
    "read_log_day",
    "read_modified_since",
    "read_snapshot",
    "read_table",
    "snapshot_path",
    "with_audit",
    "with_file_lineage",
    "write_landing",
    "write_snapshot",
]
