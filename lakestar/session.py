"""Session construction and the shared working folder.

On a cluster the shared folder is the one named by ``spark.checkpoint.dir``; it is read
from the session and never replaced.  Only a local-mode session without that setting (unit
tests, the smoke check) gets a private folder under the system temp directory.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Snapshot writes replace only the partitions present in the written frame.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(
    master: str | None = None,
    app_name: str = "lakestar",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the settings the pipeline relies on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(_DEFAULTS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    shared_dir(spark)
    return spark


_PRIVATE_KEY = "lakestar.shared.dir"


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session.  When it is unset, a local-mode
    session gets one private folder under the temp directory (kept for the session); any
    other session fails, since a machine-local folder is not visible to executors.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset static conf
            configured = None
    if not configured:
        configured = spark.conf.get(_PRIVATE_KEY, None)
    if not configured:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a folder every executor can reach"
            )
        configured = tempfile.mkdtemp(prefix="lakestar-shared-")
        spark.conf.set(_PRIVATE_KEY, configured)
    configured = configured.rstrip("/")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured + "/checkpoints")
    return configured


def workspace(spark: SparkSession, *parts: str) -> str:
    """A folder under the shared folder, unique to this application."""
    base = shared_dir(spark)
    app = spark.sparkContext.applicationId
    return "/".join([base, "lakestar", app, *parts])


def fresh_workspace(spark: SparkSession, *parts: str) -> str:
    """A never-used folder under :func:`workspace` (one per call)."""
    return workspace(spark, *parts, uuid.uuid4().hex[:12])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared checkpoint folder.

    ``checkpoint`` (never ``localCheckpoint``): the data survives the loss of the executor
    that computed it, and later stages read it instead of recomputing the plan.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so the path can be used with ``os`` in tests."""
    return path[len("file:"):] if path.startswith("file:") else path
