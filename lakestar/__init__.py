"""lakestar: a medallion (bronze / silver / gold / mart) star-schema pipeline on plain Spark.

Every step is a DataFrame -> DataFrame operator; reading and writing happen only at the
edges (``lakestar.sources``).  Nothing here needs a transactional table format: merges are
full-outer joins, surrogate keys are range-partitioned numbering, and
each layer is written as a fresh snapshot directory.
"""

from lakestar.session import get_session, shared_dir, workspace

__all__ = ["get_session", "shared_dir", "workspace"]
