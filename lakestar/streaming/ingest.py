"""Landing -> bronze as incremental file ingestion (Structured Streaming).

Each pipeline run must ingest the landing files that arrived since the previous run, once.
The streaming file source keeps the list of files it has read in its checkpoint.  Every
micro-batch is appended by the same writer that batch runs use, so both kinds of run share
one folder, its catalog entry and its compaction; files that an interrupted attempt of the
batch has already appended for this run are left out when the batch is repeated.
``trigger(availableNow=True)`` makes each run a bounded job: read what is there, stop.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakestar import schemas as S
from lakestar.functions.dates import RunContext
from lakestar.sources import tables as TB
from lakestar.sources.files import CSV_OPTIONS, with_audit, with_file_lineage


def _append_new_files(bronze_path: str, ctx: RunContext):
    """A micro-batch writer: rows of files that this run has not appended yet."""

    def append(batch: DataFrame, _: int) -> None:
        try:
            today = TB.read_log_day(batch.sparkSession, bronze_path, S.BRONZE_SCHEMA, ctx.day)
        except AnalysisException as error:
            if not TB.path_missing(error):
                raise
        else:
            done = today.where(F.col(S.RUN_ID) == ctx.run_id).select(S.INPUT_FILENAME).distinct()
            batch = batch.join(done, S.INPUT_FILENAME, "left_anti").select(*S.BRONZE_COLUMNS)
        TB.append_by_day(batch, bronze_path)

    return append


def start_landing_ingest(
    spark: SparkSession,
    landing_dir: str,
    bronze_path: str,
    checkpoint_dir: str,
    ctx: RunContext,
    schema: T.StructType = S.LANDING_SCHEMA,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start one run of the ingest: every not-yet-ingested landing file, then stop."""
    reader = spark.readStream.schema(schema).options(**CSV_OPTIONS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    rows = with_audit(with_file_lineage(reader.csv(landing_dir)), ctx).select(*S.BRONZE_COLUMNS)
    return (
        rows.writeStream.foreachBatch(_append_new_files(bronze_path, ctx))
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )


def ingest_landing(
    spark: SparkSession,
    landing_dir: str,
    bronze_path: str,
    checkpoint_dir: str,
    ctx: RunContext,
    timeout_sec: float | None = None,
) -> dict:
    """Run the ingest to completion; returns the last progress of the query."""
    q = start_landing_ingest(spark, landing_dir, bronze_path, checkpoint_dir, ctx)
    finished = q.awaitTermination(timeout_sec) if timeout_sec else q.awaitTermination()
    if finished is False:
        q.stop()
        raise TimeoutError(f"landing ingest did not finish within {timeout_sec}s")
    if q.exception() is not None:
        raise RuntimeError(f"landing ingest failed: {q.exception()}")
    return q.lastProgress or {}
