"""The medallion flow: landing -> bronze -> silver (+ errors) -> gold star -> mart.

Each step reads the tables written by the step before it and writes its own; nothing is
kept in memory between steps, so a step can be re-run alone, and the inputs of a step
survive the loss of any executor.

* :func:`landing_to_bronze` - CSV scan, file lineage, audit columns, append by day.
* :func:`bronze_to_silver` - day slice, rename, quality rule, latest row per key,
  quarantine (appended), newer-wins merge into the previous silver snapshot.
* :func:`silver_to_gold` - day slice of silver; hash-change merge of the three dimensions
  (new keys numbered after the current maximum), then the fact, whose SIDs are looked
  up in the dimension snapshots just written.
* :func:`gold_to_mart` - typed copy of the gold rows the run changed, one row per sid,
  upsert into the previous mart snapshot; the mart dimensions carry the unknown member.
* :func:`run_all` - the whole chain for one run, each step only after the previous one
  succeeded.
* :func:`compact_day` - maintenance: one day of an append-only table rewritten as few
  files.

Each layer is published under its catalog name once its snapshot is complete.
Independent tables of a step (the three dimensions; the quarantine next to the silver
merge) are processed as concurrent Spark jobs from threads of the same session; the fact
follows once its dimensions are written.  ``lakestar.flow.parallel=false`` runs them one
after the other.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestar import schemas as S
from lakestar.functions.dates import RunContext
from lakestar.operators import maintenance as MT
from lakestar.operators import mart as M
from lakestar.operators import quality as Q
from lakestar.operators import star as G
from lakestar.operators.keys import next_sid
from lakestar.operators.merging import ACTION, merge
from lakestar.session import cut_lineage
from lakestar.sources import files as FS
from lakestar.sources import tables as TB

SILVER_SCHEMA = T.StructType(
    [T.StructField(S.MEASURE if f.name == S.MEASURE_RAW else f.name, f.dataType)
     for f in S.BRONZE_SCHEMA.fields]
)
#: Bronze and errors files also keep the raw texts (JSON by column) of values that did not parse.
_RAW_TEXTS = T.StructField(FS.RESCUED, T.StringType())
BRONZE_STORED = T.StructType([*S.BRONZE_SCHEMA, _RAW_TEXTS])
ERRORS_STORED = T.StructType([*SILVER_SCHEMA, _RAW_TEXTS])
GOLD_SCHEMAS = {spec.name: spec.schema for spec in G.DIMS + (G.FACT,)}
GOLD_TABLES = tuple(GOLD_SCHEMAS)


@dataclass(frozen=True)
class Layout:
    """Where every table lives under one root folder.

    ``buckets`` > 0: new snapshots of silver, the gold fact and the mart fact are bucketed by
    their merge key into that many buckets (each snapshot remembers its own count);
    0: plain snapshots.  ``namespace`` is put before the catalog's database names, so that
    roots that should not share names (tests, the queries' history) do not.
    """

    root: str
    buckets: int = 0
    namespace: str = ""

    def _bucketing(self, keys: tuple[str, ...], sort_by: tuple[str, ...] = (),
                   partition_by: tuple[str, ...] = ()):
        if not self.buckets:
            return None
        return TB.Bucketing(tuple(keys), self.buckets, sort_by, partition_by)

    @property
    def silver_bucketing(self):
        return self._bucketing(S.NATURAL_KEY, (S.PROCESSING_DATE,))

    @property
    def fact_bucketing(self):
        return self._bucketing((S.KEY_HASH,), (S.PROCESSING_DATE,))

    @property
    def mart_fact_bucketing(self):
        # Year directories: a report about one year reads one directory (dynamic pruning).
        return self._bucketing((S.SID,), partition_by=("yearSid",))

    def target_buckets(self, spark: SparkSession, base: str, version: int | None) -> int | None:
        """The bucket count of the snapshot a merge reads."""
        if version is None or not self.buckets:
            return None
        return TB.stored_buckets(spark, base, version)

    def landing(self, filename: str) -> str:
        return f"{self.root}/landing/{filename}"

    @property
    def bronze(self) -> str:
        return f"{self.root}/bronze/names"

    @property
    def errors(self) -> str:
        return f"{self.root}/silver/names_errors"

    @property
    def silver(self) -> str:
        return f"{self.root}/silver/names"

    @property
    def audit(self) -> str:
        return f"{self.root}/audit"

    @property
    def history(self) -> str:
        return f"{self.root}/history"

    def gold(self, table: str) -> str:
        return f"{self.root}/gold/{table}"

    def mart(self, table: str) -> str:
        return f"{self.root}/mart/{table}"


def buckets_for(spark: SparkSession, input_bytes: int, bytes_per_bucket: int = 128 << 20) -> int:
    """About one bucket per ``bytes_per_bucket`` of input, at least the shuffle partitions."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, MT.target_files(input_bytes, bytes_per_bucket))


def new_layout(spark: SparkSession, root: str, buckets: int | None = None,
               default_buckets: int | None = None, namespace: str = "") -> Layout:
    """The layout of a root folder.

    New snapshots take ``buckets``, else ``lakestar.buckets``, else at least
    ``default_buckets`` (e.g. sized from a run's input), else the shuffle partition count.  The
    count is recorded in the root and never shrinks: a later run that needs more buckets takes
    a multiple, and its merges write the next snapshots with it.
    """
    stored = TB.read_number(spark, f"{root}/_layout")
    configured = spark.conf.get("lakestar.buckets", None)
    asked = buckets or (int(configured) if configured else None)
    if stored is None:
        n = asked or default_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    elif asked is None:
        n = stored * max(1, -(-(default_buckets or 0) // stored))
    elif asked % stored:
        raise ValueError(f"{root} has {stored} buckets; {asked} is no multiple of it")
    else:
        n = asked
    if n != stored:
        TB.write_number(spark, f"{root}/_layout", n)
    return Layout(root, n, namespace)


@dataclass
class StepReport:
    step: str
    metrics: dict = field(default_factory=dict)


def _parallel(spark: SparkSession, tasks: list[Callable]) -> list:
    """Run independent steps as concurrent jobs; the first failure is raised."""
    if len(tasks) <= 1 or spark.conf.get("lakestar.flow.parallel", "true").lower() != "true":
        return [task() for task in tasks]
    with ThreadPoolExecutor(max_workers=len(tasks), thread_name_prefix="lakestar") as pool:
        futures = [pool.submit(task) for task in tasks]
        return [f.result() for f in futures]


def _observe(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Action counts collected while the merge result is written (no extra pass)."""
    obs = Observation(name)
    a = F.col(ACTION)
    observed = df.observe(
        obs,
        F.count_if(a == "insert").alias("inserted"),
        F.count_if(a == "update").alias("updated"),
        F.count_if(a == "unchanged").alias("unchanged"),
        F.count_if(a == "carried").alias("carried"),
        F.count(F.lit(1)).alias("rows_out"),
    )
    return observed, obs


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df`` with its rows counted while it is written."""
    obs = Observation()
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


# ---------------------------------------------------------------------------
# P1: landing -> bronze
# ---------------------------------------------------------------------------
def landing_to_bronze(spark: SparkSession, layout: Layout, ctx: RunContext,
                      landing_path: str) -> StepReport:
    rows = FS.require_columns(FS.read_landing_rescued(spark, landing_path))
    rows = rows.withColumn(FS.RESCUED, F.to_json(FS.RESCUED))
    bronze = FS.with_audit(FS.with_file_lineage(rows), ctx)
    # The landing file of a run is one batch: a second attempt replaces the first one's rows.
    name = landing_path.rstrip("/").rsplit("/", 1)[-1]
    return StepReport("landing_to_bronze", append_bronze(bronze, layout, f"{ctx.run_id}:{name}"))


def append_bronze(bronze_rows: DataFrame, layout: Layout, batch: str | None = None) -> dict:
    """Append rows that already carry the bronze columns; returns the number appended.

    Raw texts of values that did not parse (a JSON column ``_rescued``) are kept if given.  A named ``batch`` may be appended again: it replaces its own rows.
    """
    if FS.RESCUED not in bronze_rows.columns:
        bronze_rows = bronze_rows.withColumn(FS.RESCUED, F.lit(None).cast("string"))
    rows, obs = _counted(bronze_rows.select(*BRONZE_STORED.fieldNames()))
    TB.append_by_day(rows, layout.bronze, batch=batch)
    register_bronze(bronze_rows.sparkSession, layout)
    return {"bronze": obs.get["rows"]}


def read_bronze(spark: SparkSession, layout: Layout) -> DataFrame:
    return TB.read_log(spark, layout.bronze, S.BRONZE_SCHEMA)


def register_bronze(spark: SparkSession, layout: Layout) -> str:
    """Declare the bronze folder as an external catalog table (schema under the root)."""
    database, table = S.BRONZE_TABLE
    return _register(spark, layout, database, table, layout.bronze, S.BRONZE_SCHEMA,
                     TB.LOG_PARTITIONS)


def publish(spark: SparkSession, layout: Layout, name: tuple[str, str], path: str,
            schema: T.StructType, bucketing=None, partition_by: tuple[str, ...] = ()) -> str:
    """Point a catalog name at a table folder (the last step of a layer's run).

    Snapshot layers re-point the name at the version just written, so readers switch to
    it only after it is complete; a failed run leaves the name on the previous version.
    """
    database, table = name
    clustered = ((bucketing.keys, bucketing.sort_by or bucketing.keys, bucketing.buckets)
                 if bucketing else None)
    return _register(spark, layout, database, table, path, schema, partition_by, clustered)


def publish_version(spark: SparkSession, layout: Layout, name: tuple[str, str], base: str,
                    version: int, schema: T.StructType, bucketing=None) -> str:
    """Point a catalog name at a version of a snapshot table, once it is complete."""
    if bucketing is None:
        return publish(spark, layout, name, TB.snapshot_path(base, version), schema)
    database, table = name
    database = layout.namespace + database
    declared = TB.declare_snapshot(spark, base, version, schema, bucketing)
    return TB.publish_snapshot(spark, database, table, declared, schema.fieldNames(),
                               f"{layout.root}/catalog/{database}.db")


def register_errors(spark: SparkSession, layout: Layout) -> str:
    """Declare the errors folder as an external catalog table, for analysts."""
    database, table = S.ERRORS_TABLE
    return _register(spark, layout, database, table, layout.errors, ERRORS_STORED,
                     TB.LOG_PARTITIONS)


def _register(spark: SparkSession, layout: Layout, database: str, table: str, path: str,
              schema: T.StructType, partition_by: tuple[str, ...] = (), clustered=None) -> str:
    database = layout.namespace + database
    return TB.register_external(spark, database, table, path, schema, partition_by,
                                f"{layout.root}/catalog/{database}.db", clustered=clustered)


# ---------------------------------------------------------------------------
# P2: bronze -> silver + errors
# ---------------------------------------------------------------------------
def silver_merge(current: DataFrame | None, survivors: DataFrame, with_action: bool = False,
                 target_buckets: int | None = None) -> DataFrame:
    """Newer-wins merge: a matched row is replaced only by a strictly newer file."""
    return merge(
        current,
        survivors,
        list(S.NATURAL_KEY),
        update_when=lambda t, s: t(S.INPUT_MODIFIED) < s(S.INPUT_MODIFIED),
        update_set=[S.MEASURE, S.PROCESSING_DATE, S.RUN_ID, S.INPUT_FILENAME, S.INPUT_MODIFIED],
        columns=list(SILVER_SCHEMA.fieldNames()),
        check_unique=False,  # survivors are one row per key by construction
        with_action=with_action,
        target_buckets=target_buckets,
    )


def bronze_to_silver(spark: SparkSession, layout: Layout, ctx: RunContext,
                     previous: int | None, version: int) -> StepReport:
    slice_df = Q.rename_measure(TB.read_log_day(spark, layout.bronze, BRONZE_STORED, ctx.day))
    # Survivors feed both the quarantine and the merge: materialise them once.
    kept = cut_lineage(Q.latest_per_key(Q.quality_filter(slice_df)))
    survivors = kept.drop(FS.RESCUED)

    def quarantine() -> dict:
        # Rows that differ only in the raw text of a bad value are different errors.
        errors, obs = _counted(Q.quarantine(slice_df, kept))
        TB.append_by_day(errors, layout.errors, batch=ctx.run_id)
        register_errors(spark, layout)
        return {"errors": obs.get["rows"]}

    def merge_silver() -> dict:
        plan = _touched(spark, layout, layout.silver, layout.silver_bucketing, previous, survivors)
        current = None if previous is None else read_silver(spark, layout, previous, plan.slices)
        merged, obs = _observe(
            silver_merge(current, survivors, with_action=True, target_buckets=plan.buckets),
            "silver_merge")
        TB.write_snapshot(merged.drop(ACTION), layout.silver, version,
                          cluster_by=(S.PROCESSING_DATE,), bucketing=layout.silver_bucketing,
                          deal=plan.deal, carried=plan.carried,
                          figures=lambda: {"rows": plan.rows + obs.get["inserted"]})
        publish_version(spark, layout, S.SILVER_TABLE, layout.silver, version, SILVER_SCHEMA,
                        layout.silver_bucketing)
        # Rows of slices that the run did not touch are carried as well.
        counts, found = obs.get, plan.rows + obs.get["inserted"]
        return {**counts, "rows_out": found,
                "carried": found - counts["inserted"] - counts["updated"] - counts["unchanged"]}

    # Both read the same survivors and write different tables: concurrent jobs.
    errors, merged = _parallel(spark, [quarantine, merge_silver])
    return StepReport("bronze_to_silver", {**errors, **merged})


def read_silver(spark: SparkSession, layout: Layout, version: int,
                slices: list[int] | None = None) -> DataFrame:
    return TB.read_snapshot(spark, layout.silver, version, SILVER_SCHEMA,
                            bucketing=_as_stored(layout.silver_bucketing), slices=slices)


@dataclass(frozen=True)
class Touched:
    """How a merge meets the version before: all of it, or the slices of its source's keys.

    ``slices`` None: the whole table is read and written.  ``rows`` of the version before.
    """

    slices: list[int] | None = None
    buckets: int | None = None
    deal: bool = False
    carried: tuple[int, list[int]] | None = None
    rows: int = 0
    note: dict = field(default_factory=dict)


def _touched(spark: SparkSession, layout: Layout, base: str, bucketing: TB.Bucketing | None,
             previous: int | None, source: DataFrame) -> Touched:
    """The slices that ``source`` changes; a new bucket count writes the whole table anew."""
    if previous is None:
        return Touched(deal=bucketing is not None)
    if bucketing is None:
        return Touched(rows=TB.read_snapshot(spark, base, previous).count())
    note = TB.read_note(spark, base, previous)
    if note["buckets"] != bucketing.buckets:
        return Touched(None, note["buckets"], True, None, note["rows"], note)
    hit = TB.slices_hit(source, bucketing)
    return Touched(hit, note["buckets"], False, (previous, hit), note["rows"], note)


def _as_stored(bucketing: TB.Bucketing | None) -> TB.Bucketing | None:
    return bucketing and replace(bucketing, buckets=None)


def read_errors(spark: SparkSession, layout: Layout) -> DataFrame:
    return TB.read_log(spark, layout.errors, SILVER_SCHEMA)


def read_rescued_errors(spark: SparkSession, layout: Layout) -> DataFrame:
    """Errors with the raw texts of the values that did not parse, as a map by column."""
    raw = F.from_json(FS.RESCUED, "map<string, string>")
    return TB.read_log(spark, layout.errors, ERRORS_STORED).withColumn(FS.RESCUED, raw)


# ---------------------------------------------------------------------------
# P3: silver -> gold
# ---------------------------------------------------------------------------
def read_gold(spark: SparkSession, layout: Layout, table: str, version: int,
              slices: list[int] | None = None) -> DataFrame:
    bucketing = layout.fact_bucketing if table == G.FACT.name else None
    return TB.read_snapshot(spark, layout.gold(table), version, GOLD_SCHEMAS[table],
                            bucketing=_as_stored(bucketing), slices=slices)


def silver_to_gold(spark: SparkSession, layout: Layout, ctx: RunContext, silver_version: int,
                   previous: int | None, version: int, mode: str = "exact") -> StepReport:
    silver_slice = TB.day_slice(read_silver(spark, layout, silver_version), ctx.day)
    # One scan and one shuffle of the slice for the three dimensions (exact hashes).
    deltas = (G.dimension_deltas(silver_slice) if mode == "exact"
              else {spec.name: G.delta(silver_slice, spec, mode) for spec in G.DIMS})

    metrics: dict[str, int] = {}

    def dimension(spec: G.TableSpec) -> tuple[str, DataFrame]:
        current = None if previous is None else read_gold(spark, layout, spec.name, previous)
        new, obs = _counted(G.merge_star(current, deltas[spec.name], spec))
        path = TB.write_snapshot(new, layout.gold(spec.name), version)
        metrics[spec.name] = obs.get["rows"]
        publish(spark, layout, S.GOLD_TABLE_NAMES[spec.name], path, spec.schema)
        return spec.name, read_gold(spark, layout, spec.name, version)

    dims = dict(_parallel(spark, [partial(dimension, spec) for spec in G.DIMS]))
    changed = cut_lineage(G.delta(G.fact_rows(silver_slice, dims), G.FACT, mode))
    base = layout.gold(G.FACT.name)
    plan = _touched(spark, layout, base, layout.fact_bucketing, previous, changed)
    current = None if previous is None else read_gold(spark, layout, G.FACT.name, previous, plan.slices)
    # Ids go on from the number that the version before recorded; no scan of its ids.
    start = plan.note["next_sid"] if plan.note else next_sid(current)
    obs = Observation()
    new_fact = G.merge_star(current, changed, G.FACT, target_buckets=plan.buckets, start=start,
                            materialised=True).observe(
        obs, F.count_if(F.col(S.SID) >= start).alias("inserted"))
    TB.write_snapshot(new_fact, base, version, cluster_by=(S.PROCESSING_DATE,),
                      bucketing=layout.fact_bucketing, deal=plan.deal, carried=plan.carried,
                      figures=lambda: {"rows": plan.rows + obs.get["inserted"],
                                       "next_sid": start + obs.get["inserted"]})
    metrics[G.FACT.name] = plan.rows + obs.get["inserted"]
    publish_version(spark, layout, S.GOLD_TABLE_NAMES[G.FACT.name], base, version, G.FACT.schema,
                    layout.fact_bucketing)
    return StepReport("silver_to_gold", metrics)


# ---------------------------------------------------------------------------
# P4: gold -> mart
# ---------------------------------------------------------------------------
_SINK_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}
MART_SCHEMAS = {
    t: T.StructType([T.StructField(sink, _SINK_TYPES[typ]) for _, sink, typ, _ in M.MAPPINGS[t]])
    for t in GOLD_TABLES
}


def read_mart(spark: SparkSession, layout: Layout, table: str, version: int,
              slices: list[int] | None = None) -> DataFrame:
    bucketing = layout.mart_fact_bucketing if table == G.FACT.name else None
    return TB.read_snapshot(spark, layout.mart(table), version, MART_SCHEMAS[table],
                            bucketing=_as_stored(bucketing), slices=slices)


def gold_to_mart(spark: SparkSession, layout: Layout, ctx: RunContext, gold_version: int,
                 previous: int | None, version: int, unknown_member: bool = True) -> StepReport:
    """Publish the gold rows this run changed into the previous mart snapshot.

    A gold row carries the processing date of its last change, so the run's day slice of
    gold is exactly what is new or different since the previous publish; the rest of the
    mart is carried over unchanged.  The first publish has no previous mart and takes the
    whole gold table.  The new version's keys are checked before its names are switched to it:
    a broken mart fails the run and is never published.  What is carried passed the check of the
    version before, and members never leave a dimension, so the check reads the changed rows
    and the slices they went to.
    """
    metrics: dict[str, int] = {}
    written: dict[str, tuple[DataFrame, list[int] | None]] = {}

    def write_table(table: str) -> None:
        gold = read_gold(spark, layout, table, gold_version)
        changed = gold if previous is None else TB.day_slice(gold, ctx.day)
        source = M.mart_source(changed, table)
        if unknown_member and table != G.FACT.name:
            # Gold sids start at 0, so -1 never clashes; an existing -1 row is matched
            # and rewritten with the same NULL attributes.
            source = source.unionByName(M.unknown_member_row(source))
        is_fact = table == G.FACT.name
        bucketing = layout.mart_fact_bucketing if is_fact else None
        if is_fact:
            source = cut_lineage(source)  # read by the slice list, the upsert and the key check
            plan = _touched(spark, layout, layout.mart(table), bucketing, previous, source)
        else:
            plan = Touched()
        current = None if previous is None else read_mart(spark, layout, table, previous, plan.slices)
        new, obs = _observe(M.upsert(current, source, check_unique=False,  # one row per sid
                                     target_buckets=plan.buckets, with_action=True), f"mart_{table}")
        TB.write_snapshot(new.drop(ACTION), layout.mart(table), version, bucketing=bucketing,
                          deal=plan.deal, carried=plan.carried,
                          figures=lambda: {"rows": plan.rows + obs.get["inserted"]})
        metrics[table] = plan.rows + obs.get["inserted"] if is_fact else obs.get["rows_out"]
        written[table] = source, plan.slices

    _parallel(spark, [partial(write_table, t) for t in GOLD_TABLES])
    require_sound_mart(spark, layout, version, *written[G.FACT.name])
    for table in sorted(GOLD_TABLES, key=G.FACT.name.__eq__):  # the fact after its members
        publish_version(spark, layout, S.MART_TABLE_NAMES[table], layout.mart(table), version,
                        MART_SCHEMAS[table],
                        layout.mart_fact_bucketing if table == G.FACT.name else None)
    return StepReport("gold_to_mart", metrics)


def require_sound_mart(spark: SparkSession, layout: Layout, version: int,
                       changed: DataFrame | None = None, slices: list[int] | None = None) -> None:
    """Fail on a repeated sid, or on a fact row whose key has no member (NULL passes).

    ``changed``: the fact rows that are new in this version, ``slices``: where they went (both
    None: the whole fact is checked).  A sid's rows share a slice, so a repeated one shows there.
    """
    for table in GOLD_TABLES:
        rows = read_mart(spark, layout, table, version, slices if table == G.FACT.name else None)
        if not M.pk_violations(rows).isEmpty():
            raise ValueError(f"mart {table} version {version}: repeated sid")
    orphans = [r for r in mart_checks(spark, layout, version, changed).collect() if r["orphan_rows"]]
    if orphans:
        raise ValueError(f"mart version {version}: fact rows without member: {orphans}")


def compact_day(spark: SparkSession, layout: Layout, day, table: str = "bronze",
                file_bytes: int = 256 << 20) -> int:
    """Rewrite one day of an append-only table (bronze or errors) as few, full files.

    Every run appends its own files to the day's directory; this maintenance step reads
    the directory, sizes the output from the rows it holds (:func:`~.maintenance.files_needed`:
    no task sorts or writes more than about ``file_bytes`` of them), materialises the
    range-clustered rows in the shared checkpoint folder and swaps only that day's directory,
    batch by batch.  Rows and their batches are unchanged, so a batch can
    still be appended again.  Refuses when another writer has added files
    meanwhile.  Returns the number of files written.
    """
    path, schema = {"bronze": (layout.bronze, BRONZE_STORED),
                    "errors": (layout.errors, ERRORS_STORED)}[table]
    day_rows = TB.read_log_partition(spark, path, schema, day)
    before = TB.day_files(spark, path, day)
    n = MT.files_needed(day_rows, file_bytes, stored=sum(before.values()))
    keys = [S.BATCH, *(c for c in S.NATURAL_KEY if c in schema.fieldNames()), S.PROCESSING_DATE]
    # Cut from the files first: the write replaces the directory it was read from.
    staged = cut_lineage(MT.compacted(day_rows, n, keys))
    if TB.day_files(spark, path, day) != before:
        raise RuntimeError(f"{path}: files of {day} changed while they were compacted")
    TB.replace_day(staged, path)
    return len(TB.day_files(spark, path, day))


def compact_days(spark: SparkSession, layout: Layout, ctx: RunContext, version: int, table: str,
                 days: list) -> int:
    """Compact days of bronze or errors, recorded as the last operation of the table's version."""
    left = {day: compact_day(spark, layout, day, table) for day in days}
    files = sum(left.values())
    row = (table, version, ctx.run_id, MT.COMPACT,
           {"numDays": str(len(days)), "numAddedFiles": str(files),
            **{f"{MT.FILES_OF_DAY}{day}": str(n) for day, n in left.items()}})
    _write_of_run(spark, [row], HISTORY_SCHEMA, layout.history,
                  f"{ctx.run_id}:{MT.COMPACT}:{table}", version)
    return files


def compact_if_due(spark: SparkSession, layout: Layout, ctx: RunContext, version: int,
                   least_files: int = 16, recent: int = MT.RECENT_OPERATIONS) -> dict:
    """Compact the fragmented days of bronze and errors, if their history says they are due.

    Due: none of the table's last ``recent`` operations was a compaction.  Fragmented: at least
    ``least_files`` files, and more than twice as many as the day's bytes need or its last
    compaction left.  All days since the last compaction are looked at, by a listing.  Returns the files written per table.
    """
    history = read_history(spark, layout)
    due = {r["table"] for r in MT.compaction_due(history, recent)
           .where("due").select("table").collect()}
    out = {}
    for table, path in (("bronze", layout.bronze), ("errors", layout.errors)):
        if table in due:
            found = MT.fragmented(TB.log_files(spark, path), least_files,
                                  left=MT.files_left(history, table))
            days = [r["day"] for r in found.select("day").orderBy("day").collect()]
            if days:
                out[f"compacted_{table}"] = compact_days(spark, layout, ctx, version, table, days)
    return out


def mart_checks(spark: SparkSession, layout: Layout, version: int,
                fact: DataFrame | None = None) -> DataFrame:
    """Foreign-key orphan counts of a mart version (of the fact rows given, or of all)."""
    dims = {t: read_mart(spark, layout, t, version) for t in GOLD_TABLES if t != G.FACT.name}
    if fact is None:
        fact = read_mart(spark, layout, G.FACT.name, version)
    return M.fk_orphans(fact, dims)


# ---------------------------------------------------------------------------
# P5: the whole run
# ---------------------------------------------------------------------------
def run_all(spark: SparkSession, layout: Layout, ctx: RunContext, version: int,
            landing_path: str | None = None, bronze_rows: DataFrame | None = None) -> list:
    """One run through every layer; ``version - 1`` is the previous snapshot (if any).

    Every step is recorded with its counts once it is complete, and starts only after the step
    before it is.  A run that failed is started again with the same arguments: complete steps are
    not repeated, the failed one replaces what its first attempt left.
    """
    previous = version - 1 if version > 1 else None
    steps: list[tuple[str, Callable[[], StepReport]]] = []
    if landing_path is not None:
        steps.append(("landing_to_bronze",
                      lambda: landing_to_bronze(spark, layout, ctx, landing_path)))
    elif bronze_rows is not None:
        steps.append(("append_bronze", lambda: StepReport(
            "append_bronze", append_bronze(bronze_rows, layout, f"{ctx.run_id}:rows"))))
    steps += [
        ("bronze_to_silver", lambda: bronze_to_silver(spark, layout, ctx, previous, version)),
        ("silver_to_gold", lambda: silver_to_gold(spark, layout, ctx, version, previous, version)),
        ("gold_to_mart", lambda: gold_to_mart(spark, layout, ctx, version, previous, version)),
    ]
    done = completed_steps(spark, layout, ctx, version)
    reports = []
    for name, step in steps:
        if name not in done:
            done[name] = step().metrics
            _complete(spark, layout, ctx, version, name, done[name])
        reports.append(StepReport(name, done[name]))
    if AUDIT_STEP not in done:
        record_run(spark, layout, ctx, version, reports)
        _complete(spark, layout, ctx, version, AUDIT_STEP, {})
    compact_if_due(spark, layout, ctx, version)  # last: nothing of the run reads it any more
    return reports


AUDIT_SCHEMA = "run_id string, version int, step string, metric string, value long"
HISTORY_SCHEMA = ("table string, version int, run_id string, operation string, "
                  "metrics map<string, string>")
STEP_SCHEMA = "metrics map<string, bigint>"
AUDIT_STEP = "record_run"


def _step_path(layout: Layout, ctx: RunContext, version: int, step: str) -> str:
    return f"{layout.root}/steps/run={ctx.run_id}/v={int(version):06d}/step={step}"


def _complete(spark: SparkSession, layout: Layout, ctx: RunContext, version: int, step: str,
              metrics: dict) -> None:
    """Record a complete step and its counts (one row)."""
    (spark.createDataFrame([({k: int(v) for k, v in metrics.items()},)], STEP_SCHEMA).coalesce(1)
     .write.mode("overwrite").parquet(_step_path(layout, ctx, version, step)))


def completed_steps(spark: SparkSession, layout: Layout, ctx: RunContext,
                    version: int) -> dict[str, dict]:
    """The complete steps of a run and their counts."""
    try:
        rows = spark.read.schema(f"{STEP_SCHEMA}, step string").parquet(
            _step_path(layout, ctx, version, "").rsplit("/", 1)[0]).collect()
    except AnalysisException as error:
        if TB.path_missing(error):
            return {}
        raise
    return {r["step"]: dict(r["metrics"]) for r in rows}


def record_run(spark: SparkSession, layout: Layout, ctx: RunContext, version: int,
               reports: list[StepReport]) -> None:
    """Write the run's observed counts to the audit table and to the tables' history.

    Both are partitioned by run and version; a second attempt replaces its own rows.
    """
    rows = [(ctx.run_id, version, r.step, name, int(value))
            for r in reports for name, value in sorted(r.metrics.items())]
    history = [(table, version, ctx.run_id, operation, {k: str(v) for k, v in metrics.items()})
               for r in reports for table, operation, metrics in _operations(r)]
    for path, found, schema in ((layout.audit, rows, AUDIT_SCHEMA),
                                (layout.history, history, HISTORY_SCHEMA)):
        _write_of_run(spark, found, schema, path, ctx.run_id, version)


def _write_of_run(spark: SparkSession, rows: list[tuple], schema: str, path: str, run: str,
                  version: int) -> None:
    """Write a run's few rows into its own partition; a second attempt replaces them."""
    (spark.createDataFrame(rows, schema).coalesce(1)
     .withColumns({"of_run": F.lit(run), "of_version": F.lit(version)})
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("of_run", "of_version").parquet(path))


def _operations(report: StepReport) -> list[tuple[str, str, dict]]:
    """(table, operation, metrics) of the tables that a step wrote."""
    m = report.metrics
    if report.step in ("append_bronze", "landing_to_bronze"):
        return [("bronze", "WRITE", {"numOutputRows": m["bronze"]})]
    if report.step == "bronze_to_silver":
        merged = {"numOutputRows": m["rows_out"], "numTargetRowsInserted": m["inserted"],
                  "numTargetRowsUpdated": m["updated"], "numTargetRowsDeleted": 0,
                  "numTargetRowsCopied": m["unchanged"] + m["carried"]}
        return [("errors", "WRITE", {"numOutputRows": m["errors"]}), ("silver", "MERGE", merged)]
    layer = {"silver_to_gold": "gold", "gold_to_mart": "mart"}[report.step]
    return [(f"{layer}_{t}", "MERGE", {"numOutputRows": n}) for t, n in sorted(m.items())]


def read_history(spark: SparkSession, layout: Layout) -> DataFrame:
    """One row per table and version: the operation that wrote it and its metrics by name."""
    return spark.read.schema(HISTORY_SCHEMA).parquet(layout.history).select(
        "table", "version", "run_id", "operation", "metrics")


def read_audit(spark: SparkSession, layout: Layout) -> DataFrame:
    columns = [c.split()[0] for c in AUDIT_SCHEMA.split(", ")]
    return spark.read.schema(AUDIT_SCHEMA).parquet(layout.audit).select(*columns)
