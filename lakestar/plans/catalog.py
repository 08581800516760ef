"""Registered queries: one per operator of the pipeline, each over the test tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame.  Operators are run live
on the inputs they need (read from the two-run history in the shared folder, see
:mod:`lakestar.plans.scenario`); the flow queries read what the flow wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestar import schemas as S
from lakestar.functions import dates as D
from lakestar.functions.hashing import COMPAT, EXACT, sha256_of
from lakestar.operators import dedup as DD
from lakestar.operators import keys as K
from lakestar.operators import maintenance as MT
from lakestar.operators import mart as M
from lakestar.operators import quality as Q
from lakestar.operators import reports as R
from lakestar.operators import star as G
from lakestar.operators.merging import ambiguous_keys as _ambiguous_keys
from lakestar.operators.merging import merge_metrics as _merge_metrics
from lakestar.plans import medallion as P
from lakestar.plans.scenario import Scenario
from lakestar.session import fresh_workspace
from lakestar.sources import feed as FD
from lakestar.sources import files as FS
from lakestar.sources import tables as TB
from lakestar import streaming as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Report parameters on the derived feed (sex/year/name of the original
# reports mapped onto the feed's values).
TOP_SEX, TOP_YEAR = "R", 1998
TOP3_SEX, TOP3_YEAR = "A", 1999
NAME = "red widget"
NAME_CI = "RED WIDGET"
RUN_AUDIT = D.RunContext.from_params("run-audit", "21-05-2024 18:39:52")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _sc(spark: SparkSession, sf_dir: str) -> Scenario:
    return Scenario.of(spark, sf_dir)


def _survivors(sc: Scenario, ctx) -> tuple[DataFrame, DataFrame]:
    slice_df = Q.rename_measure(sc.bronze_day(ctx))
    return slice_df, Q.latest_per_key(Q.quality_filter(slice_df))


# ---------------------------------------------------------------------------
# Scans and sources
# ---------------------------------------------------------------------------
@query
def scan_csv(spark, sf_dir):
    """Landing CSV written from the feed, scanned back with the declared schema."""
    path = fresh_workspace(spark, "scan_csv")
    FS.write_landing(FD.landing_rows(FD.names_feed(spark, sf_dir)), path)
    return FS.read_landing(spark, path)


@query
def scan_csv_inferred(spark, sf_dir):
    """Landing CSV scanned with inferred types, brought to the declared schema."""
    path = fresh_workspace(spark, "scan_inferred")
    FS.write_landing(FD.landing_rows(FD.names_feed(spark, sf_dir)), path)
    return FS.reconciled(FS.read_landing(spark, path, infer=True), S.LANDING_SCHEMA)


@query
def rescued_values(spark, sf_dir):
    """Landing CSV whose counts of every fifth year do not parse: their raw text is kept."""
    path = fresh_workspace(spark, "rescued")
    rows = FD.landing_rows(FD.names_feed(spark, sf_dir))
    spoiled = F.when(F.col("year") % 5 == 0, F.concat(F.lit("~"), F.col(S.MEASURE_RAW)))
    FS.write_landing(rows.withColumn(S.MEASURE_RAW, F.coalesce(
        spoiled, F.col(S.MEASURE_RAW).cast("string"))), path)
    return FS.read_landing_rescued(spark, path).select(
        *S.LANDING_COLUMNS, F.col(FS.RESCUED)[S.MEASURE_RAW].alias("raw_count"))


@query
def scan_table(spark, sf_dir):
    """Whole bronze table through its catalog name (external table over the folder)."""
    sc = _sc(spark, sf_dir)
    name = P.register_bronze(spark, sc.layout)
    TB.require_table(spark, name)
    return spark.read.table(name).select(*S.BRONZE_COLUMNS)


@query
def file_lineage(spark, sf_dir):
    """Landing files of both runs: each row's source file (from its path) and file time."""
    feed = FD.names_feed(spark, sf_dir)
    base = fresh_workspace(spark, "lineage")
    for ctx, name in ((FD.RUN_1, FD.FILE_1), (FD.RUN_2, FD.FILE_2)):
        FS.write_landing(FD.landing_rows(FD.run_rows(feed, ctx)), f"{base}/{name}")
    rows = FS.with_file_lineage(FS.read_landing(spark, f"{base}/*/*.csv"))
    # The landing file is the folder the part file sits in; the time is the file system's.
    return rows.select(
        *S.LANDING_COLUMNS,
        F.regexp_extract(S.INPUT_FILENAME, r"/([^/]+)/[^/]+$", 1).alias("landing_file"),
        F.col(S.INPUT_MODIFIED).isNotNull().alias("has_file_time"),
    )


@query
def scan_modified_since(spark, sf_dir):
    """Raw Parquet files of the fact folder written since the second run began."""
    sc = _sc(spark, sf_dir)
    return FS.read_modified_since(spark, sc.layout.gold("fact"), sc.second_run_began,
                                  schema=S.FACT_SCHEMA)


@query
def scan_mart_by_name(spark, sf_dir):
    """The published mart fact, read through its catalog name."""
    sc = _sc(spark, sf_dir)
    database, table = S.MART_TABLE_NAMES["fact"]
    name = f"{sc.layout.namespace}{database}.{table}"
    TB.require_table(spark, name)
    return spark.read.table(name).select(*P.MART_SCHEMAS["fact"].fieldNames())


@query
def incremental_slice(spark, sf_dir):
    """Bronze rows processed on the second run's day."""
    return _sc(spark, sf_dir).bronze_day(FD.RUN_2)


# ---------------------------------------------------------------------------
# Sinks
# ---------------------------------------------------------------------------
@query
def bronze_append(spark, sf_dir):
    """Bronze after two appends (union of both runs)."""
    return _sc(spark, sf_dir).bronze()


@query
def bronze_append_twice(spark, sf_dir):
    """Bronze after both runs were appended, each in two attempts."""
    feed = FD.names_feed(spark, sf_dir)
    layout = P.Layout(fresh_workspace(spark, "append_twice"), namespace="twice_")
    for ctx in FD.RUNS:
        for _ in range(2):
            P.append_bronze(FD.run_rows(feed, ctx), layout, batch=ctx.run_id)
    return P.read_bronze(spark, layout)


@query
def silver_first_load(spark, sf_dir):
    """Merge into a missing silver table = the first run's survivors."""
    _, survivors = _survivors(_sc(spark, sf_dir), FD.RUN_1)
    return P.silver_merge(None, survivors)


@query
def csv_requote_roundtrip(spark, sf_dir):
    """Bronze rows written as all-quoted CSV (doubled quotes) and read back."""
    path = fresh_workspace(spark, "requote")
    FS.write_landing(FD.names_feed(spark, sf_dir), path, rfc4180=True)
    return FS.read_landing(spark, path, schema=S.BRONZE_SCHEMA, rfc4180=True)


def _mart_copy(table):
    def run(spark, sf_dir):
        return M.mart_copy(_sc(spark, sf_dir).gold(table, 2), table)

    run.__name__ = f"mart_copy_{'fact' if table == 'fact' else table}"
    run.__doc__ = f"Typed, column-mapped copy of gold {table}."
    return query(run)


for _t in ("dim_names", "dim_years", "dim_locations", "fact"):
    _mart_copy(_t)


# ---------------------------------------------------------------------------
# Projections and filters
# ---------------------------------------------------------------------------
@query
def quality_clean(spark, sf_dir):
    """Rows of the whole bronze table that pass the quality rule."""
    return Q.quality_filter(Q.rename_measure(_sc(spark, sf_dir).bronze()))


@query
def audit_columns(spark, sf_dir):
    """Landing rows with the run's processing time and run id."""
    return FS.with_audit(FD.landing_rows(FD.names_feed(spark, sf_dir)), RUN_AUDIT)


@query
def rename_measure(spark, sf_dir):
    """Bronze with the measure renamed."""
    return Q.rename_measure(_sc(spark, sf_dir).bronze())


@query
def unknown_member(spark, sf_dir):
    """All silver rows looked up in the first-run dimensions; misses get -1."""
    sc = _sc(spark, sf_dir)
    rows = sc.silver(2)
    return G.lookup_sids(rows, sc.gold_dims(1)).select(
        *S.NATURAL_KEY, "nameSid", "yearSid", "locationSid", S.MEASURE, S.RUN_ID, S.PROCESSING_DATE
    )


@query
def filter_ci(spark, sf_dir):
    """Silver rows of one name, compared case-insensitively."""
    silver = _sc(spark, sf_dir).silver(2)
    return silver.filter(F.collate(F.col("first_name"), "UTF8_LCASE") == F.lit(NAME_CI))


# ---------------------------------------------------------------------------
# Joins
# ---------------------------------------------------------------------------
def _lookup(spec):
    def run(spark, sf_dir):
        sc = _sc(spark, sf_dir)
        return G.lookup_sids(sc.silver(2), sc.gold_dims(1), specs=[spec], unknown=None)

    run.__name__ = {"dim_names": "lookup_name_sid", "dim_years": "lookup_year_sid",
                    "dim_locations": "lookup_location_sid"}[spec.name]
    run.__doc__ = f"Silver (run 2) left-joined to {spec.name} (run 1) on its business key."
    return query(run)


for _spec in G.DIMS:
    _lookup(_spec)


@query
def quarantine(spark, sf_dir):
    """Both runs, each by itself: every distinct slice row that did not survive."""
    sc = _sc(spark, sf_dir)
    parts = [Q.quarantine(*_survivors(sc, ctx)) for ctx in FD.RUNS]
    return parts[0].unionByName(parts[1])


@query
def fk_orphans(spark, sf_dir):
    """All of silver as fact rows against the run-1 dimensions: orphans per foreign key."""
    sc = _sc(spark, sf_dir)
    facts = G.lookup_sids(sc.silver(2), sc.gold_dims(1))
    return M.fk_orphans(facts, sc.gold_dims(1))


@query
def fk_check_mart(spark, sf_dir):
    """Foreign-key orphan counts of the published mart (with unknown members)."""
    sc = _sc(spark, sf_dir)
    return P.mart_checks(spark, sc.layout, 2)


# ---------------------------------------------------------------------------
# Aggregations
# ---------------------------------------------------------------------------
def _dedup(spec):
    def run(spark, sf_dir):
        return G.delta(_sc(spark, sf_dir).silver(2), spec)

    run.__name__ = {"dim_names": "dedup_names", "dim_years": "dedup_years",
                    "dim_locations": "dedup_locations"}[spec.name]
    run.__doc__ = f"Whole silver reduced to one {spec.name} row per key hash."
    return query(run)


for _spec in G.DIMS:
    _dedup(_spec)


@query
def dedup_fact(spark, sf_dir):
    """Whole silver as fact rows (run-2 dimensions), one row per key hash."""
    sc = _sc(spark, sf_dir)
    return G.delta(G.fact_rows(sc.silver(2), sc.gold_dims(2)), G.FACT)


def _both_versions(sc: Scenario, table: str) -> DataFrame:
    return sc.gold(table, 1).unionByName(sc.gold(table, 2))


@query
def mart_dedup_distinct(spark, sf_dir):
    """Distinct mart rows over both versions of each dimension, stacked."""
    sc = _sc(spark, sf_dir)
    parts = [M.mart_source(_both_versions(sc, spec.name), spec.name, dedup="distinct")
             .withColumn("dim", F.lit(spec.name)) for spec in G.DIMS]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@query
def pk_violations(spark, sf_dir):
    """Fact sids that stay duplicated after a distinct over both versions."""
    sc = _sc(spark, sf_dir)
    return M.pk_violations(DD.distinct_rows(M.mart_copy(_both_versions(sc, "fact"), "fact")))


# ---------------------------------------------------------------------------
# Windows
# ---------------------------------------------------------------------------
@query
def latest_per_key(spark, sf_dir):
    """Latest valid row per natural key over the whole bronze table."""
    return Q.latest_per_key(Q.quality_filter(Q.rename_measure(_sc(spark, sf_dir).bronze())))


@query
def mart_dedup_rownum(spark, sf_dir):
    """Newest version of each fact sid over both versions, then the typed copy."""
    sc = _sc(spark, sf_dir)
    return M.mart_source(_both_versions(sc, "fact"), "fact", dedup="rownum")


# ---------------------------------------------------------------------------
# Reports
# ---------------------------------------------------------------------------
def _mart_star(sc: Scenario):
    return sc.mart("fact", 2), sc.mart("dim_names", 2), sc.mart("dim_years", 2)


@query
def report_top10_f(spark, sf_dir):
    """Top 10 names of one sex in one year."""
    fact, names, years = _mart_star(_sc(spark, sf_dir))
    return R.top_names(spark, fact, names, years, TOP_SEX, TOP_YEAR, 10)


@query
def report_name_by_year(spark, sf_dir):
    """One name's total per year."""
    fact, names, years = _mart_star(_sc(spark, sf_dir))
    return R.name_by_year(spark, fact, names, years, NAME)


@query
def report_top3_m(spark, sf_dir):
    """Top 3 names of one sex in one year."""
    fact, names, years = _mart_star(_sc(spark, sf_dir))
    return R.top_names(spark, fact, names, years, TOP3_SEX, TOP3_YEAR, 3)


@query
def report_top10_all(spark, sf_dir):
    """Top 10 names overall, straight from silver."""
    return R.top_names_silver(spark, _sc(spark, sf_dir).silver(2), 10)


# ---------------------------------------------------------------------------
# Merge, upsert, identity
# ---------------------------------------------------------------------------
@query
def merge_newer_wins(spark, sf_dir):
    """Silver of run 1 merged with the survivors of run 2 (newer file wins)."""
    sc = _sc(spark, sf_dir)
    _, survivors = _survivors(sc, FD.RUN_2)
    buckets = sc.layout.target_buckets(spark, sc.layout.silver, 1)
    return P.silver_merge(sc.silver(1), survivors, target_buckets=buckets)


@query
def merge_metrics(spark, sf_dir):
    """Inserted / updated / unchanged / carried counts of the run-2 silver merge."""
    sc = _sc(spark, sf_dir)
    _, survivors = _survivors(sc, FD.RUN_2)
    return _merge_metrics(P.silver_merge(sc.silver(1), survivors, with_action=True))


def _merge_dim(spec):
    def run(spark, sf_dir):
        sc = _sc(spark, sf_dir)
        return G.merge_star(sc.gold(spec.name, 1), G.delta(sc.silver_day(2, FD.RUN_2), spec), spec)

    run.__name__ = f"merge_{spec.name}"
    run.__doc__ = f"Hash-change merge of run 2 into {spec.name} (new sids after the max)."
    return query(run)


for _spec in G.DIMS:
    _merge_dim(_spec)


@query
def merge_fact(spark, sf_dir):
    """Hash-change merge of run 2's facts into the run-1 fact."""
    sc = _sc(spark, sf_dir)
    facts = G.fact_rows(sc.silver_day(2, FD.RUN_2), sc.gold_dims(2))
    return G.merge_star(sc.gold("fact", 1), G.delta(facts, G.FACT), G.FACT,
                        target_buckets=sc.layout.target_buckets(spark, sc.layout.gold("fact"), 1))


def _upsert(table):
    def run(spark, sf_dir):
        sc = _sc(spark, sf_dir)
        changed = TB.day_slice(sc.gold(table, 2), FD.RUN_2.day)
        buckets = (sc.layout.target_buckets(spark, sc.layout.mart(table), 1)
                   if table == "fact" else None)
        return M.upsert(sc.mart(table, 1), M.mart_source(changed, table), target_buckets=buckets)

    run.__name__ = f"upsert_{table}"
    run.__doc__ = f"Mart {table} of run 1 upserted with the gold rows changed by run 2."
    return query(run)


for _t in ("dim_names", "dim_years", "dim_locations", "fact"):
    _upsert(_t)


@query
def assign_sid(spark, sf_dir):
    """Dense ordered ids over every natural key of silver."""
    keys = _sc(spark, sf_dir).silver(2).select(*S.NATURAL_KEY)
    return K.assign_sid(keys, list(S.NATURAL_KEY))


@query
def assign_sid_incremental(spark, sf_dir):
    """Ids for run-1 keys, then ids after the maximum for the keys run 2 adds."""
    sc = _sc(spark, sf_dir)
    first = K.assign_sid(sc.silver(1).select(*S.NATURAL_KEY), list(S.NATURAL_KEY))
    added = G.unmatched(sc.silver(2).select(*S.NATURAL_KEY), first, list(S.NATURAL_KEY))
    second = K.assign_sid(added, list(S.NATURAL_KEY), start=K.next_sid(first))
    return first.unionByName(second)


@query
def merge_ambiguous_keys(spark, sf_dir):
    """Key hashes that repeat in the undeduplicated names source (the merge guard)."""
    rows = G.source_rows(_sc(spark, sf_dir).silver(2), G.DIM_NAMES)
    return _ambiguous_keys(rows, [S.KEY_HASH])


# ---------------------------------------------------------------------------
# Scalar functions
# ---------------------------------------------------------------------------
@query
def hash_keys(spark, sf_dir):
    """Key hashes of every silver row for the three dimensions, and its value hash."""
    silver = _sc(spark, sf_dir).silver(2)
    return silver.select(
        *S.NATURAL_KEY,
        sha256_of(G.DIM_NAMES.key).alias("name_key_hash"),
        sha256_of(G.DIM_YEARS.key).alias("year_key_hash"),
        sha256_of(G.DIM_LOCATIONS.key).alias("location_key_hash"),
        sha256_of([S.RUN_ID, S.PROCESSING_DATE]).alias("value_hash"),
    )


@query
def hash_collisions(spark, sf_dir):
    """Distinct fact keys vs distinct exact / unseparated key hashes (all of silver)."""
    sc = _sc(spark, sf_dir)
    facts = G.fact_rows(sc.silver(2), sc.gold_dims(2))
    return facts.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(sha256_of(G.FACT.key, EXACT)).alias("n_exact_hashes"),
        F.count_distinct(sha256_of(G.FACT.key, COMPAT)).alias("n_compat_hashes"),
    )


@query
def parse_dates(spark, sf_dir):
    """Processing dates of bronze written as run parameters and parsed back."""
    runs = _sc(spark, sf_dir).bronze().select(S.PROCESSING_DATE).distinct()
    return runs.select(
        S.PROCESSING_DATE,
        D.format_day(S.PROCESSING_DATE).alias("day_param"),
        D.format_timestamp(S.PROCESSING_DATE).alias("ts_param"),
        D.parse_day_col(D.format_day(S.PROCESSING_DATE)).alias("day_start"),
        D.parse_timestamp_col(D.format_timestamp(S.PROCESSING_DATE)).alias("parsed_ts"),
        F.to_date(S.PROCESSING_DATE).alias("processing_day"),
    )


@query
def run_parameters(spark, sf_dir):
    """Per run: landing file name, processing-time text and the mart copy cut-off."""
    runs = _sc(spark, sf_dir).bronze().select(S.RUN_ID, S.PROCESSING_DATE).distinct()
    return runs.select(
        S.RUN_ID,
        F.concat(F.lit(S.LANDING_FILE_PREFIX), D.format_day(S.PROCESSING_DATE),
                 F.lit(S.LANDING_FILE_SUFFIX)).alias("landing_file"),
        D.format_timestamp(S.PROCESSING_DATE).alias("ts_param"),
        (F.col(S.PROCESSING_DATE) - F.expr("INTERVAL 1 DAY")).alias("modified_since"),
    )


# ---------------------------------------------------------------------------
# Maintenance
# ---------------------------------------------------------------------------
@query
def compact_preserves_rows(spark, sf_dir):
    """Silver rewritten as few range-clustered files, sized by its rows, and read back."""
    silver = _sc(spark, sf_dir).silver(2)
    path = fresh_workspace(spark, "compact")
    MT.compacted(silver, MT.files_needed(silver), list(S.NATURAL_KEY)).write.mode("overwrite").parquet(path)
    return spark.read.schema(P.SILVER_SCHEMA).parquet(path)


# ---------------------------------------------------------------------------
# The flow, layer by layer
# ---------------------------------------------------------------------------
@query
def run_bronze(spark, sf_dir):
    """Landing CSV files of both runs ingested into a fresh bronze table."""
    feed = FD.names_feed(spark, sf_dir)
    layout = P.Layout(fresh_workspace(spark, "landing_run"))
    for ctx, name in ((FD.RUN_1, FD.FILE_1), (FD.RUN_2, FD.FILE_2)):
        path = layout.landing(name)
        FS.write_landing(FD.landing_rows(FD.run_rows(feed, ctx)), path)
        P.landing_to_bronze(spark, layout, ctx, path)
    return P.read_bronze(spark, layout).select(*S.LANDING_COLUMNS, S.PROCESSING_DATE, S.RUN_ID)


@query
def stream_bronze(spark, sf_dir):
    """Incremental ingest: run 1 reads the first landing file, run 2 only the new one."""
    feed = FD.names_feed(spark, sf_dir)
    base = fresh_workspace(spark, "stream_ingest")
    landing, bronze, ckpt = f"{base}/landing", f"{base}/bronze", f"{base}/_checkpoint"
    for ctx, name in ((FD.RUN_1, FD.FILE_1), (FD.RUN_2, FD.FILE_2)):
        FS.write_landing(FD.landing_rows(FD.run_rows(feed, ctx)), f"{landing}/{name}")
        ST.ingest_landing(spark, f"{landing}/*", bronze, ckpt, ctx)
    return TB.read_log(spark, bronze, S.BRONZE_SCHEMA).select(
        *S.LANDING_COLUMNS, S.PROCESSING_DATE, S.RUN_ID)


@query
def run_silver(spark, sf_dir):
    """Silver after both runs."""
    return _sc(spark, sf_dir).silver(2)


@query
def run_errors(spark, sf_dir):
    """Errors table after both runs."""
    return _sc(spark, sf_dir).errors()


@query
def run_dims(spark, sf_dir):
    """The three gold dimensions after both runs, stacked."""
    sc = _sc(spark, sf_dir)
    parts = [sc.gold(spec.name, 2).withColumn("dim", F.lit(spec.name)) for spec in G.DIMS]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@query
def run_fact(spark, sf_dir):
    """Gold fact after both runs."""
    return _sc(spark, sf_dir).gold("fact", 2)


@query
def run_mart(spark, sf_dir):
    """Published mart fact with its dimension attributes."""
    sc = _sc(spark, sf_dir)
    f = sc.mart("fact", 2)
    n = sc.mart("dim_names", 2).withColumnRenamed("sid", "nameSid")
    y = sc.mart("dim_years", 2).withColumnRenamed("sid", "yearSid")
    loc = sc.mart("dim_locations", 2).withColumnRenamed("sid", "locationSid")
    return (
        f.join(n, "nameSid").join(y, "yearSid").join(loc, "locationSid")
        .select("sid", "first_name", "sex", "year", "county", "count")
    )


@query
def run_audit(spark, sf_dir):
    """The counts that both runs observed while they wrote every layer."""
    return P.read_audit(spark, _sc(spark, sf_dir).layout)


@query
def compact_day(spark, sf_dir):
    """Bronze written by several appends a day, then compacted day by day."""
    feed = FD.names_feed(spark, sf_dir)
    layout = P.Layout(fresh_workspace(spark, "compact_day"), namespace="compacted_")
    for ctx in FD.RUNS:
        rows = FD.run_rows(feed, ctx)
        for part in ("year % 2 = 0", "year % 2 = 1", "year is null"):
            P.append_bronze(rows.where(part), layout)
        P.compact_day(spark, layout, ctx.day)
    return P.read_bronze(spark, layout)


@query
def table_history(spark, sf_dir):
    """What wrote every version of every table, its metrics read by name from the map."""
    metric = F.col("metrics")
    named = {"output_rows": "numOutputRows", "inserted": "numTargetRowsInserted",
             "updated": "numTargetRowsUpdated", "copied": "numTargetRowsCopied"}
    written = P.read_history(spark, _sc(spark, sf_dir).layout).where(
        F.col("operation") != MT.COMPACT)
    return written.select(
        "table", "version", "operation",
        *(metric[key].cast("long").alias(name) for name, key in named.items()))


@query
def compaction_due(spark, sf_dir):
    """Guard of the compaction by recent operations (here 3): bronze appended six times and
    compacted after the first run, all other tables as the two-run history left them."""
    sc = _sc(spark, sf_dir)  # its bronze holds the feed: not joined again for every append
    layout = P.Layout(fresh_workspace(spark, "compaction_due"), namespace="due_")
    version = 0
    for ctx in FD.RUNS:
        for part in ("year % 2 = 0", "year % 2 = 1", "year is null"):
            version += 1
            appended = P.append_bronze(sc.bronze_day(ctx).where(part), layout)
            P.record_run(spark, layout, ctx, version, [P.StepReport("append_bronze", appended)])
        if ctx is FD.RUN_1:
            P.compact_days(spark, layout, ctx, version, "bronze", [ctx.day])
    others = P.read_history(spark, sc.layout).where(
        ~F.col("table").isin("bronze", "errors"))
    return MT.compaction_due(P.read_history(spark, layout).unionByName(others), recent=3)


@query
def run_errors_rescued(spark, sf_dir):
    """Errors of a landing file whose counts of every fifth year do not parse, with raw texts."""
    layout = P.new_layout(spark, fresh_workspace(spark, "errors_rescued"), namespace="rescued_")
    rows = FD.landing_rows(FD.run_rows(FD.names_feed(spark, sf_dir), FD.RUN_1))
    spoiled = F.when(F.col("year") % 5 == 0, F.concat(F.lit("~"), F.col(S.MEASURE_RAW)))
    path = layout.landing(FD.FILE_1)
    FS.write_landing(rows.withColumn(S.MEASURE_RAW, F.coalesce(
        spoiled, F.col(S.MEASURE_RAW).cast("string"))), path)
    P.landing_to_bronze(spark, layout, FD.RUN_1, path)
    P.bronze_to_silver(spark, layout, FD.RUN_1, None, 1)
    raw = F.col(FS.RESCUED)[S.MEASURE_RAW]
    return P.read_rescued_errors(spark, layout).where(raw.isNotNull()).select(
        *S.NATURAL_KEY, S.MEASURE, raw.alias("raw_count")).distinct()
