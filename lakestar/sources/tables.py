"""Layer tables on storage: append-only logs and snapshot versions.

* ``bronze`` and the silver errors table are append-only, partitioned by processing day,
  so the daily slice of a later step reads one directory (partition pruning) and the
  timestamp bounds are pushed to the Parquet reader.
* ``silver``, ``gold`` and ``mart`` tables are written as a new snapshot directory per run
  (``.../v=000002``).  The previous snapshot is only read, never overwritten, so a failed
  run leaves the last good version in place, and re-running a run rewrites its own
  version.
* The large tables (silver, gold fact, mart fact) are written *bucketed* by their merge
  key (:class:`Bucketing`) and read back through a catalog entry that declares the
  buckets.  The next merge then finds the target already hash-partitioned on the key and
  shuffles only the source to match: the table that grows with history is never
  shuffled again.
* Their buckets lie in *slices* (a partition column, the key's hash modulo the slice count,
  which divides the bucket count).  A merge reads and writes the slices that its source's keys
  fall into; the new version's catalog entry takes the other slices' partitions from where the
  versions before left them.  A note beside the versions records which version holds a slice.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from lakestar import schemas as S
from lakestar.functions.dates import day_literal, day_predicate
from lakestar.session import shared_dir

SNAPSHOT_DB = "lakestar_snapshots"
#: Partition column of bucketed snapshots, and the most slices of a table.
SLICE, MOST_SLICES = "slice", 1024


@dataclass(frozen=True)
class Bucketing:
    """Hash buckets of a snapshot: ``buckets`` files per version, by ``keys``.

    The count belongs to the snapshot: it is recorded with the files when they are written
    and read back from there, so a table may grow by writing its next snapshot with more
    buckets.  ``buckets=None`` (reading): whatever the snapshot has; another count than the
    recorded one is refused, since rows would silently go missing.  ``sort_by`` orders
    rows inside each bucket file (e.g. by processing date, for row-group skipping).
    ``partition_by``: partition directories above the buckets, for pruning (a filter or
    a dynamic-pruning join on those columns reads only the matching directories).
    """

    keys: tuple[str, ...]
    buckets: int | None
    sort_by: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()

    @property
    def slices(self) -> int:
        """The largest divisor of the bucket count that is at most ``MOST_SLICES``."""
        return next(n for n in range(min(self.buckets, MOST_SLICES), 0, -1) if self.buckets % n == 0)

    def slice_of(self) -> Column:
        """A row's slice: buckets are the same hash modulo a multiple, so none spans two slices."""
        return F.pmod(F.hash(*self.keys), F.lit(self.slices)).alias(SLICE)


def path_missing(error: AnalysisException) -> bool:
    """Whether a read failed because its path does not exist (any other failure is real)."""
    return (error.getCondition() or "").startswith("PATH_NOT_FOUND")


def write_number(spark: SparkSession, path: str, number: int) -> None:
    """One number as a small text file."""
    (spark.createDataFrame([(str(int(number)),)], "value string").coalesce(1)
     .write.mode("overwrite").text(path))


def read_number(spark: SparkSession, path: str) -> int | None:
    """The number written to ``path``; None when there is none."""
    try:
        rows = spark.read.text(path).collect()
    except AnalysisException as error:
        if path_missing(error):
            return None
        raise
    return int(rows[0]["value"])


def _note_path(base: str, version: int) -> str:
    return f"{base.rstrip('/')}/_versions/v={int(version):06d}"


def write_note(spark: SparkSession, base: str, version: int, note: dict) -> None:
    """What is known of a bucketed version, as one line beside the versions."""
    (spark.createDataFrame([(json.dumps(note, sort_keys=True),)], "value string").coalesce(1)
     .write.mode("overwrite").text(_note_path(base, version)))


def read_note(spark: SparkSession, base: str, version: int) -> dict:
    """buckets, from (slice -> the version that holds its files) and the writer's figures."""
    try:
        rows = spark.read.text(_note_path(base, version)).collect()
    except AnalysisException as error:
        if path_missing(error):
            raise FileNotFoundError(f"table snapshot {snapshot_path(base, version)} not found, "
                                    "or written without buckets") from error
        raise
    return json.loads(rows[0]["value"])


def stored_buckets(spark: SparkSession, base: str, version: int) -> int:
    """The bucket count recorded with a snapshot."""
    return read_note(spark, base, version)["buckets"]


def slices_hit(source: DataFrame, bucketing: Bucketing) -> list[int]:
    """The slices that the source's keys fall into (at most ``MOST_SLICES`` numbers)."""
    return sorted(r[0] for r in source.select(bucketing.slice_of()).distinct().collect())


def snapshot_path(base: str, version: int) -> str:
    return f"{base.rstrip('/')}/v={int(version):06d}"


LOG_PARTITIONS = (S.PROCESSING_DAY, S.BATCH)


def append_by_day(df: DataFrame, path: str, ts_col: str = S.PROCESSING_DATE,
                  batch: str | None = None) -> None:
    """Append rows, partitioned by the day of ``ts_col`` and the batch (creates the table).

    A named ``batch`` is written once: a second attempt replaces what the first left of that day
    and batch (dynamic partition overwrite), so a failed or repeated append never doubles rows.
    Without a name every call is a batch of its own.  An attempt without rows replaces nothing.
    """
    name = batch if batch is not None else uuid.uuid4().hex[:12]
    (
        df.withColumns({S.PROCESSING_DAY: F.to_date(F.col(ts_col)), S.BATCH: F.lit(name)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*LOG_PARTITIONS)
        .parquet(path)
    )


def _with_day(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(S.PROCESSING_DAY, T.DateType()),
                         T.StructField(S.BATCH, T.StringType())])


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Whole append-only table, declared columns only."""
    return spark.read.schema(_with_day(schema)).parquet(path).select(*schema.fieldNames())


def read_log_day(spark: SparkSession, path: str, schema: T.StructType, day: date,
                 ts_col: str = S.PROCESSING_DATE) -> DataFrame:
    """Rows processed on ``day``: one partition directory, bounds pushed to Parquet."""
    df = spark.read.schema(_with_day(schema)).parquet(path)
    return df.filter((F.col(S.PROCESSING_DAY) == day_literal(day)) & day_predicate(ts_col, day)) \
        .select(*schema.fieldNames())


def read_log_partition(spark: SparkSession, path: str, schema: T.StructType,
                       day: date) -> DataFrame:
    """One day directory of an append-only table, partition columns included."""
    return spark.read.schema(_with_day(schema)).parquet(path).filter(
        F.col(S.PROCESSING_DAY) == day_literal(day))


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """Day and length of every file of an append-only table (a listing: no file is opened)."""
    day = F.regexp_extract("path", rf"/{S.PROCESSING_DAY}=(\d{{4}}-\d{{2}}-\d{{2}})/", 1)
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet").load(path)
            .select(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date").alias("day"), "length")
            .where(F.col("day").isNotNull()))


def day_files(spark: SparkSession, path: str, day: date) -> dict[str, int]:
    """Path and length of the files of one day of an append-only table (a listing, as above)."""
    try:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                 .option("pathGlobFilter", "*.parquet").load(f"{path}/{S.PROCESSING_DAY}={day:%Y-%m-%d}"))
    except AnalysisException as error:
        if path_missing(error):
            return {}
        raise
    return {r["path"]: r["length"] for r in files.select("path", "length").collect()}


def replace_day(df: DataFrame, path: str) -> None:
    """Overwrite only the days' batches present in ``df`` (dynamic partition overwrite,
    set on this write so a session default of static overwrite cannot drop other days)."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*LOG_PARTITIONS)
        .parquet(path)
    )


def day_slice(df: DataFrame, day: date, ts_col: str = S.PROCESSING_DATE) -> DataFrame:
    """Rows of any frame whose timestamp falls on ``day``."""
    return df.filter(day_predicate(ts_col, day))


def snapshot_table(base: str, version: int) -> str:
    """Catalog name of a bucketed snapshot (derived from its location)."""
    digest = hashlib.sha1(_norm(base).encode()).hexdigest()[:12]
    return f"{SNAPSHOT_DB}.s{digest}_v{int(version):06d}"


def _ensure_snapshot_db(spark: SparkSession) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{SNAPSHOT_DB}` "
              f"LOCATION '{shared_dir(spark)}/catalog/{SNAPSHOT_DB}.db'")


def write_snapshot(df: DataFrame, base: str, version: int,
                   partition_by: tuple[str, ...] = (), cluster_by: tuple[str, ...] = (),
                   bucketing: Bucketing | None = None, deal: bool = False,
                   carried: tuple[int, Iterable[int]] | None = None,
                   figures: Callable[[], dict] | None = None) -> str:
    """Write one snapshot version (overwrite: a re-run rewrites the same version).

    ``cluster_by``: rows are sorted inside each task before writing, so Parquet row-group
    statistics on those columns are tight and a later range filter (the day slice on
    ``_processing_date``) skips the row groups of other days.  A local sort, no shuffle.
    ``bucketing``: hash-bucketed by key in slices, registered in the catalog (external table);
    the note that makes it a version is written once the files are complete.  ``deal``: the
    rows are not yet partitioned like the buckets (a first load, or a new count); they are
    shuffled once so that every task writes one bucket rather than a piece of all.
    ``carried``: an earlier version and the slices that ``df`` holds; every other slice stays
    in the files of the earlier version.  ``figures``: what else to note, known after the write.
    """
    path = snapshot_path(base, version)
    if bucketing is not None:
        spark = df.sparkSession
        held = {}
        if carried is not None:
            earlier, written = carried[0], set(carried[1])
            held = {k: v for k, v in read_note(spark, base, earlier)["from"].items()
                    if int(k) not in written}
        _ensure_snapshot_db(spark)
        name = snapshot_table(base, version)
        if spark.catalog.tableExists(name):
            spark.sql(f"DROP TABLE {name}")  # external: the files stay until overwritten
        sort_by = bucketing.sort_by or cluster_by or bucketing.keys
        if deal:
            df = df.repartition(bucketing.buckets, *bucketing.keys)
        (
            df.withColumn(SLICE, bucketing.slice_of()).write.mode("overwrite")
            # The version's folder is its own: an earlier attempt's slices go.
            .option("partitionOverwriteMode", "static")
            .partitionBy(SLICE, *bucketing.partition_by)
            .bucketBy(bucketing.buckets, *bucketing.keys)
            .sortBy(*sort_by)
            .option("path", path)
            .saveAsTable(name)
        )
        own = {p.split("/")[0].split("=")[1] for p in _partitions(spark, name)}
        spark.sql(f"DROP TABLE {name}")  # declared with the carried slices when it is read
        write_note(spark, base, version, {
            "buckets": bucketing.buckets, "from": held | dict.fromkeys(own, int(version)),
            **(figures() if figures else {})})
        return path
    if cluster_by:
        df = df.sortWithinPartitions(*cluster_by)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def _partitions(spark: SparkSession, name: str) -> list[str]:
    """The partitions of a catalog table, as ``slice=3`` or ``slice=3/yearSid=7``."""
    return [r[0] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()]


def declare_snapshot(spark: SparkSession, base: str, version: int, schema: T.StructType,
                     bucketing: Bucketing, note: dict | None = None) -> str:
    """The catalog entry of a bucketed version, made once per application.

    Its own slices are found in its folder; a slice carried from an earlier version is added with
    the location of that version's files, which are neither read nor copied.
    """
    name = snapshot_table(base, version)
    _ensure_snapshot_db(spark)
    if spark.catalog.tableExists(name):
        return name
    note = note or read_note(spark, base, version)
    db, table = name.split(".")
    path = snapshot_path(base, version)
    fields = T.StructType([*schema.fields, T.StructField(SLICE, T.IntegerType())])
    register_external(spark, db, table, path, fields, (SLICE, *bucketing.partition_by),
                      clustered=(bucketing.keys, bucketing.sort_by or bucketing.keys, note["buckets"]))
    holders: dict[int, set[str]] = {}
    for k, holder in note["from"].items():
        if holder != int(version):
            holders.setdefault(holder, set()).add(k)
    adds = []
    for holder, slices in sorted(holders.items()):
        there = declare_snapshot(spark, base, holder, schema, bucketing)
        for part in _partitions(spark, there):
            values = [p.split("=", 1) for p in part.split("/")]
            if values[0][1] in slices:
                spec = ", ".join(f"`{c}` = " + ("NULL" if v == "__HIVE_DEFAULT_PARTITION__" else v)
                                 for c, v in values)
                adds.append(f"PARTITION ({spec}) LOCATION '{snapshot_path(base, holder)}/{part}'")
    for at in range(0, len(adds), 500):
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {' '.join(adds[at:at + 500])}")
    return name


def read_snapshot(spark: SparkSession, base: str, version: int,
                  schema: T.StructType | None = None,
                  bucketing: Bucketing | None = None,
                  slices: Iterable[int] | None = None) -> DataFrame:
    """One snapshot version; fails with a clear message when it does not exist.

    A bucketed snapshot is read through its catalog entry (declared again when this
    application has not seen it), so the scan reports its hash partitioning; ``slices``: only
    the files of these are listed and read.
    """
    path = snapshot_path(base, version)
    if bucketing is not None:
        note = read_note(spark, base, version)
        if bucketing.buckets not in (None, note["buckets"]):
            raise ValueError(f"{path} has {note['buckets']} buckets, not {bucketing.buckets}")
        df = spark.read.table(declare_snapshot(spark, base, version, schema, bucketing, note))
        if slices is not None:
            df = df.where(F.col(SLICE).isin(list(slices)))
        return df.select(*schema.fieldNames())
    try:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        df = reader.parquet(path)
        df.schema  # noqa: B018 - resolve now so a missing path fails here
    except AnalysisException as exc:
        if path_missing(exc):
            raise FileNotFoundError(f"table snapshot {path} not found") from exc
        raise
    if schema is not None:
        df = df.select(*schema.fieldNames())
    return df


def publish_snapshot(spark: SparkSession, database: str, table: str, source: str,
                     columns: Iterable[str], db_location: str) -> str:
    """Point a catalog name at a declared version: a view that is replaced in one step."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{database}` LOCATION '{db_location}'")
    name = f"`{database}`.`{table}`"
    if (spark.catalog.tableExists(f"{database}.{table}")
            and spark.catalog.getTable(f"{database}.{table}").tableType != "VIEW"):
        spark.sql(f"DROP TABLE {name}")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT "
              f"{', '.join(f'`{c}`' for c in columns)} FROM {source}")
    return f"{database}.{table}"


def register_external(spark: SparkSession, database: str, table: str, path: str,
                      schema: T.StructType, partition_by: tuple[str, ...] = (),
                      db_location: str | None = None,
                      clustered: tuple[tuple[str, ...], tuple[str, ...], int] | None = None) -> str:
    """Register a table folder in the catalog: ``CREATE SCHEMA`` + external ``CREATE TABLE``.

    The table is declared over its location (nothing is copied); new partition folders
    written by later appends are picked up with ``RECOVER PARTITIONS``.
    """
    where = f" LOCATION '{db_location}'" if db_location else ""
    if db_location or not spark.catalog.databaseExists(database):
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{database}`{where}")
    fields = list(schema.fields) + [
        T.StructField(p, T.DateType() if p == S.PROCESSING_DAY else T.StringType())
        for p in partition_by if p not in schema.fieldNames()
    ]
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    parts = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    if clustered:
        keys, sort_by, buckets = clustered
        parts += (f" CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(sort_by)})"
                  f" INTO {int(buckets)} BUCKETS")
    name = f"`{database}`.`{table}`"
    if spark.catalog.tableExists(f"{database}.{table}"):
        location, buckets = _declared(spark, name)
        same = location == _norm(path)
        if buckets != (clustered[2] if clustered else None) or (partition_by and not same):
            # Declared anew: another bucket count, or partitions listed under the old location.
            spark.sql(f"DROP TABLE {name}")
        elif not same:
            # Same name, next version: switched in place, readers never miss the table.
            spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet{parts} LOCATION '{path}'")
    if partition_by:
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return f"{database}.{table}"


def _norm(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path.rstrip("/")


def _declared(spark: SparkSession, name: str) -> tuple[str | None, int | None]:
    """Location and bucket count of a catalog table."""
    rows = {r["col_name"]: r["data_type"]
            for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    buckets = rows.get("Num Buckets")
    return (_norm(rows["Location"]) if "Location" in rows else None,
            int(buckets) if buckets else None)


def require_table(spark: SparkSession, name: str) -> None:
    """Fail the run when a table the step depends on is missing."""
    if not spark.catalog.tableExists(name):
        raise RuntimeError(f"table {name} not found")
