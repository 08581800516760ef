"""Incremental (streaming) entry points of the pipeline."""

from lakestar.streaming.ingest import ingest_landing, start_landing_ingest

__all__ = ["ingest_landing", "start_landing_ingest"]
