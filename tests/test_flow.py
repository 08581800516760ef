"""The whole flow from landing CSV files, run by run, and its invariants."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import SF0001
from lakestar import schemas as S
from lakestar.plans import medallion as P
from lakestar.sources import feed as FD
from lakestar.sources import files as FS


@pytest.fixture(scope="module")
def flow(spark):
    from lakestar.session import fresh_workspace

    feed = FD.names_feed(spark, SF0001)
    layout = P.new_layout(spark, fresh_workspace(spark, "flow"))
    reports = []
    for version, (ctx, name) in enumerate(((FD.RUN_1, FD.FILE_1), (FD.RUN_2, FD.FILE_2)), start=1):
        path = layout.landing(name)
        FS.write_landing(FD.landing_rows(FD.run_rows(feed, ctx)), path)
        reports.append(P.run_all(spark, layout, ctx, version, landing_path=path))
    return layout, reports


def test_bronze_holds_both_landing_files_with_lineage(spark, flow):
    layout, _ = flow
    bronze = P.read_bronze(spark, layout)
    assert bronze.count() == FD.names_feed(spark, SF0001).count()
    files = {r[0].rsplit("/", 2)[-2] for r in bronze.select(S.INPUT_FILENAME).distinct().collect()}
    assert files == {FD.FILE_1, FD.FILE_2}
    assert bronze.filter(F.col(S.INPUT_MODIFIED).isNull()).count() == 0


def test_silver_is_one_row_per_key_and_errors_are_the_rest(spark, flow):
    layout, reports = flow
    silver = P.read_silver(spark, layout, 2)
    assert silver.count() == silver.select(*S.NATURAL_KEY).distinct().count()
    metrics = reports[1][1].metrics
    assert metrics["rows_out"] == silver.count()
    assert metrics["inserted"] + metrics["updated"] + metrics["unchanged"] > 0


def test_gold_and_mart_keys_hold(spark, flow):
    layout, _ = flow
    fact = P.read_gold(spark, layout, "fact", 2)
    assert fact.count() == P.read_silver(spark, layout, 2).count()
    assert fact.select("sid").distinct().count() == fact.count()
    assert {r["orphan_rows"] for r in P.mart_checks(spark, layout, 2).collect()} == {0}
    mart = P.read_mart(spark, layout, "fact", 2)
    assert mart.count() == fact.count()


def test_run_needs_its_predecessor(spark, tmp_dir):
    layout = P.new_layout(spark, tmp_dir)
    with pytest.raises(FileNotFoundError):
        P.gold_to_mart(spark, layout, FD.RUN_1, 1, None, 1)


def test_layers_are_published_under_their_catalog_names(spark, flow):
    layout, _ = flow
    assert spark.read.table("bronze.new_york_baby_names").count() == P.read_bronze(spark, layout).count()
    assert spark.read.table("silver.new_york_baby_names").count() == P.read_silver(spark, layout, 2).count()
    assert spark.read.table("silver.new_york_baby_names_errors").count() == P.read_errors(spark, layout).count()
    for table, (db, name) in S.GOLD_TABLE_NAMES.items():
        assert spark.read.table(f"{db}.{name}").count() == P.read_gold(spark, layout, table, 2).count()


def test_compact_day_keeps_rows_and_other_days(spark, tmp_dir):
    import os

    from lakestar.session import local_path

    layout = P.new_layout(spark, tmp_dir)
    feed = FD.names_feed(spark, SF0001)
    for ctx in FD.RUNS:
        rows = FD.run_rows(feed, ctx)
        for part in range(3):  # several small appends on the same day
            P.append_bronze(rows.filter(F.col("year") % 3 == part).repartition(4), layout)
    before = {r[0]: r[1] for r in P.read_bronze(spark, layout).groupBy(S.RUN_ID).count().collect()}
    day_dir = os.path.join(local_path(layout.bronze), f"{S.PROCESSING_DAY}={FD.RUN_2.day}")

    def listed():
        return [f for _, _, files in os.walk(day_dir) for f in files if f.endswith(".parquet")]

    files_before = listed()

    written = P.compact_day(spark, layout, FD.RUN_2.day)

    files_after = listed()
    after = {r[0]: r[1] for r in P.read_bronze(spark, layout).groupBy(S.RUN_ID).count().collect()}
    assert after == before  # both days intact, nothing lost or doubled
    assert len(files_after) == written < len(files_before)


def test_command_line_runs_and_reports(spark, tmp_dir):
    from lakestar.__main__ import main

    feed = FD.names_feed(spark, SF0001)
    for version, (ctx, name) in enumerate(((FD.RUN_1, FD.FILE_1), (FD.RUN_2, FD.FILE_2)), start=1):
        landing = f"{tmp_dir}/landing/{name}"
        FS.write_landing(FD.landing_rows(FD.run_rows(feed, ctx)), landing)
        steps = main(["run", "--root", f"{tmp_dir}/root", "--landing", landing,
                      "--run-id", ctx.run_id, "--processing-date", ctx.timestamp_param,
                      "--version", str(version)], spark=spark)
        assert [s["step"] for s in steps] == ["landing_to_bronze", "bronze_to_silver",
                                             "silver_to_gold", "gold_to_mart"]
    top = main(["report", "top-names", "--root", f"{tmp_dir}/root", "--version", "2",
                "--sex", "R", "--year", "1998"], spark=spark)
    assert 0 < len(top) <= 10 and set(top[0]) == {"first_name", "total_count"}
    by_year = main(["report", "name-by-year", "--root", f"{tmp_dir}/root", "--version", "2",
                    "--name", "RED WIDGET", "--case-insensitive"], spark=spark)
    assert by_year and all(r["total_count"] > 0 for r in by_year)


def test_bucket_sizing_rule(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert P.buckets_for(spark, 0) == least            # never a single task by default
    assert P.buckets_for(spark, 300 << 20) == max(least, 3)
    assert P.buckets_for(spark, 1 << 50) == 1 << 23    # about 128 MB a bucket, no cap


def test_mart_is_published_by_name_and_only_when_sound(spark, flow, monkeypatch):
    layout, _ = flow
    database, table = S.MART_TABLE_NAMES["fact"]
    published = spark.read.table(f"{database}.{table}")
    assert published.count() == P.read_mart(spark, layout, "fact", 2).count()
    # A mart whose fact names a member that is missing fails the run and keeps its names.
    monkeypatch.setattr(P.M, "unknown_member_row", lambda dim: dim.where("sid = 0").limit(0))
    source = P.M.mart_source

    def broken(gold, name):
        rows = source(gold, name)
        return rows.where("sid <> 0") if name == "dim_years" else rows

    monkeypatch.setattr(P.M, "mart_source", broken)
    with pytest.raises(ValueError, match="without member"):
        P.gold_to_mart(spark, layout, FD.RUN_2, 2, None, 3)
    assert spark.read.table(f"{database}.{table}").count() == published.count()


def test_two_roots_keep_their_own_names(spark, tmp_dir):
    feed = FD.run_rows(FD.names_feed(spark, SF0001), FD.RUN_1)
    for name, n in (("a_", 5), ("b_", 7)):
        P.append_bronze(feed.limit(n), P.Layout(f"{tmp_dir}/{name}", namespace=name))
    assert spark.read.table("a_bronze.new_york_baby_names").count() == 5
    assert spark.read.table("b_bronze.new_york_baby_names").count() == 7


def test_every_branch_has_rows(spark):
    """The feed takes each branch that the registered queries claim."""
    from __spark_entry__ import queries

    q = {n: queries()[n](spark, SF0001) for n in (
        "unknown_member", "fk_orphans", "lookup_name_sid", "mart_copy_dim_names", "dedup_names",
        "scan_modified_since")}
    assert all(q["unknown_member"].where(f"{c} = -1").count() for c in ("nameSid", "yearSid", "locationSid"))
    assert all(r["orphan_rows"] for r in q["fk_orphans"].collect())
    assert q["lookup_name_sid"].where("nameSid is null").count()
    assert q["mart_copy_dim_names"].where("length(first_name) = 265").count()
    assert q["dedup_names"].where("length(first_name) > 265").count()
    from lakestar.plans.scenario import Scenario

    sc = Scenario.of(spark, SF0001)
    for table in ("dim_names", "dim_years", "dim_locations"):
        assert sc.gold(table, 2).count() > sc.gold(table, 1).count()
    assert q["scan_modified_since"].count() == sc.gold("fact", 2).count() > sc.gold("fact", 1).count()


def test_history_follows_the_input_files(spark, tmp_dir):
    from lakestar.plans.scenario import FEED_TABLES, Scenario

    for t in FEED_TABLES:
        spark.read.parquet(f"{SF0001}/{t}.parquet").write.parquet(f"{tmp_dir}/in/{t}.parquet")
    first = Scenario.of(spark, f"{tmp_dir}/in")
    assert Scenario.of(spark, f"{tmp_dir}/in") is first
    half = spark.read.parquet(f"{SF0001}/lineitem.parquet").where("l_orderkey % 2 = 0")
    half.write.mode("overwrite").parquet(f"{tmp_dir}/in/lineitem.parquet")
    second = Scenario.of(spark, f"{tmp_dir}/in")
    assert second is not first and second.bronze().count() < first.bronze().count()


def test_compaction_refuses_a_day_that_others_write(spark, tmp_dir, monkeypatch):
    layout = P.new_layout(spark, tmp_dir)
    rows = FD.run_rows(FD.names_feed(spark, SF0001), FD.RUN_1).limit(20)
    P.append_bronze(rows, layout)
    compacted = P.MT.compacted

    def meanwhile(df, n, keys):
        P.append_bronze(rows, layout)
        return compacted(df, n, keys)

    monkeypatch.setattr(P.MT, "compacted", meanwhile)
    with pytest.raises(RuntimeError, match="changed while"):
        P.compact_day(spark, layout, FD.RUN_1.day)
    assert P.read_bronze(spark, layout).count() == 40


def test_a_run_compacts_a_fragmented_day(spark, tmp_dir):
    layout = P.new_layout(spark, tmp_dir, namespace="frag_")
    rows = FD.run_rows(FD.names_feed(spark, SF0001), FD.RUN_1)
    P.append_bronze(rows.repartition(20), layout)
    P.run_all(spark, layout, FD.RUN_1, 1, bronze_rows=rows.limit(10))
    assert P.read_bronze(spark, layout).count() == rows.count() + 10
    assert len(P.read_bronze(spark, layout).inputFiles()) < 5
    # The next run finds a compaction among the last operations and leaves the table alone.
    second = FD.run_rows(FD.names_feed(spark, SF0001), FD.RUN_2)
    P.append_bronze(second.repartition(20), layout)
    P.run_all(spark, layout, FD.RUN_2, 2, bronze_rows=second.limit(10))
    history = P.read_history(spark, layout).where("table = 'bronze'")
    assert history.where("operation = 'COMPACT'").select("version").collect() == [(1,)]
    due = P.MT.compaction_due(history).first()
    assert (due.compacted_version, due.operations, due.rows_since, due.due) == (1, 1, 10, False)
    assert len(P.read_bronze(spark, layout).inputFiles()) >= 20
    assert "compacted_bronze" in P.compact_if_due(spark, layout, FD.RUN_2, 2, recent=1)
    assert len(P.read_bronze(spark, layout).inputFiles()) < 10
    assert P.read_bronze(spark, layout).count() == rows.count() + second.count() + 20


def test_no_task_of_a_compaction_takes_a_well_compressed_day_whole(spark, tmp_dir):
    layout = P.new_layout(spark, tmp_dir, namespace="packed_")
    one = FD.run_rows(FD.names_feed(spark, SF0001), FD.RUN_1).where("first_name is not null").limit(1)
    rows = one.crossJoin(spark.range(40_000).select()).repartition(20)
    P.append_bronze(rows, layout)
    day = P.TB.read_log_partition(spark, layout.bronze, P.BRONZE_STORED, FD.RUN_1.day)
    bound = 1 << 20
    held = P.MT.row_bytes(day)
    assert held > 4 * bound > 8 * P.MT.input_bytes(day)  # stored, the day is far smaller
    written = P.compact_day(spark, layout, FD.RUN_1.day, file_bytes=bound)
    in_file = P.TB.read_log(spark, layout.bronze, P.BRONZE_STORED).groupBy(
        F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert written >= held // bound and in_file < 2 * 40_000 / written
    assert P.read_bronze(spark, layout).count() == 40_000


def test_files_that_a_compaction_left_are_not_compacted_again(spark):
    files = spark.createDataFrame([(FD.RUN_1.day, 1000)] * 40 + [(FD.RUN_2.day, 1000)] * 41,
                                  "day date, length long")
    history = spark.createDataFrame(
        [("bronze", 1, "r", "COMPACT", {f"{P.MT.FILES_OF_DAY}{FD.RUN_1.day}": "20",
                                        f"{P.MT.FILES_OF_DAY}{FD.RUN_2.day}": "30"}),
         ("bronze", 2, "r", "COMPACT", {f"{P.MT.FILES_OF_DAY}{FD.RUN_2.day}": "20"}),
         ("errors", 3, "r", "COMPACT", {f"{P.MT.FILES_OF_DAY}{FD.RUN_1.day}": "1"})],
        P.HISTORY_SCHEMA)
    found = P.MT.fragmented(files, 16, left=P.MT.files_left(history, "bronze"))
    assert [(r.day, r.files) for r in found.collect()] == [(FD.RUN_2.day, 41)]


def test_raw_texts_of_bad_values_reach_the_errors(spark, tmp_dir):
    layout = P.new_layout(spark, tmp_dir, namespace="raw_")
    path = layout.landing("raw.csv")
    spark.createDataFrame(
        [("2001", "A", "KINGS", "F", "12"), ("2001", "B", "KINGS", "F", "1,5"),
         ("2001", "B", "KINGS", "F", "1,6"), ("n/a", "C", "KINGS", "F", "x"),
         ("2001", None, "KINGS", "F", "3")],
        "year string, first_name string, county string, sex string, name_count string",
    ).coalesce(1).write.option("header", True).option("quoteAll", True).csv(path)
    P.run_all(spark, layout, FD.RUN_1, 1, landing_path=path)
    expected = {(2001, "B", None, '{"name_count":"1,5"}'), (2001, "B", None, '{"name_count":"1,6"}'),
                (None, "C", None, '{"year":"n/a","name_count":"x"}'), (2001, None, 3, None)}
    P.compact_day(spark, layout, FD.RUN_1.day)  # the raw texts stay in bronze and in the errors
    P.compact_day(spark, layout, FD.RUN_1.day, "errors")
    stored = P.TB.read_log(spark, layout.errors, P.ERRORS_STORED)
    assert {(r.year, r.first_name, r["count"], r._rescued) for r in stored.collect()} == expected
    raw = P.TB.read_log(spark, layout.bronze, P.BRONZE_STORED).where("_rescued is not null")
    assert raw.count() == 3
    assert P.read_errors(spark, layout).columns == list(S.SILVER_COLUMNS)
    assert [r.first_name for r in P.read_silver(spark, layout, 1).collect()] == ["A"]
    maps = {r._rescued["name_count"] for r in P.read_rescued_errors(spark, layout).collect()
            if r._rescued}
    assert maps == {"1,5", "1,6", "x"}


def test_appends_may_be_repeated(spark, tmp_dir):
    layout = P.new_layout(spark, tmp_dir, namespace="again_")
    feed = FD.names_feed(spark, SF0001)
    landing = f"{tmp_dir}/landing/{FD.FILE_1}"
    FS.write_landing(FD.landing_rows(FD.run_rows(feed, FD.RUN_1)), landing)
    for _ in range(2):
        P.landing_to_bronze(spark, layout, FD.RUN_1, landing)
        P.bronze_to_silver(spark, layout, FD.RUN_1, None, 1)
    rows = FD.run_rows(feed, FD.RUN_1).count()
    once = P.read_errors(spark, layout)
    assert P.read_bronze(spark, layout).count() == rows
    assert once.count() == once.distinct().count() > 0
    assert spark.read.table("again_bronze.new_york_baby_names").count() == rows
    # Compaction keeps the batches apart, so that a batch can still be repeated.
    P.compact_day(spark, layout, FD.RUN_1.day)
    P.landing_to_bronze(spark, layout, FD.RUN_1, landing)
    assert P.read_bronze(spark, layout).count() == rows


def test_a_failed_run_resumes_where_it_failed(spark, tmp_dir, monkeypatch):
    layout = P.new_layout(spark, tmp_dir, namespace="resume_")
    feed = FD.names_feed(spark, SF0001)
    P.run_all(spark, layout, FD.RUN_1, 1, bronze_rows=FD.run_rows(feed, FD.RUN_1))
    second = FD.run_rows(feed, FD.RUN_2)
    begun, step = [], P.bronze_to_silver
    monkeypatch.setattr(P, "bronze_to_silver", lambda *a: begun.append("silver") or step(*a))
    fact_rows = P.G.fact_rows

    def broken(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(P.G, "fact_rows", broken)
    with pytest.raises(RuntimeError, match="lost"):
        P.run_all(spark, layout, FD.RUN_2, 2, bronze_rows=second)
    assert set(P.completed_steps(spark, layout, FD.RUN_2, 2)) == {"append_bronze", "bronze_to_silver"}
    monkeypatch.setattr(P.G, "fact_rows", fact_rows)
    for _ in range(2):  # the second time nothing is left to do
        reports = P.run_all(spark, layout, FD.RUN_2, 2, bronze_rows=second)
        assert [r.step for r in reports] == ["append_bronze", "bronze_to_silver", "silver_to_gold",
                                             "gold_to_mart"]
    assert begun == ["silver"]
    from lakestar.plans.scenario import Scenario

    straight = Scenario.of(spark, SF0001)
    for found, expected in (
            (P.read_bronze(spark, layout), straight.bronze()), (P.read_errors(spark, layout), straight.errors()),
            (P.read_silver(spark, layout, 2), straight.silver(2)),
            (P.read_mart(spark, layout, "fact", 2), straight.mart("fact", 2)),
            (P.read_audit(spark, layout), P.read_audit(spark, straight.layout))):
        assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()
    metrics = P.read_history(spark, layout).where("table = 'silver' and version = 2").first().metrics
    assert int(metrics["numTargetRowsInserted"]) == reports[1].metrics["inserted"]
