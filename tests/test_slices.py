"""Merges that read and write only the slices their source touches."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from helpers import T1, T2, row, silver_rows
from lakestar import schemas as S
from lakestar.plans import medallion as P
from lakestar.session import local_path
from lakestar.sources import feed as FD
from lakestar.sources import tables as TB


def bronze(spark, rows, ctx):
    """Rows (year, name, county, sex, count, file time) of a run, with the bronze columns."""
    full = [(y, n, c, x, k, ctx.processing_ts, ctx.run_id, "f.csv", m) for y, n, c, x, k, m in rows]
    return spark.createDataFrame(full, S.BRONZE_SCHEMA)


def written(path):
    """slice -> data files of a version's folder."""
    return {d: [f for _, _, files in os.walk(os.path.join(path, d)) for f in files if f.endswith(".parquet")]
            for d in os.listdir(path) if d.startswith("slice=")}


@pytest.fixture(scope="module")
def runs(spark):
    """A first run of 600 names over 64 buckets; a second that changes one and brings one."""
    from lakestar.session import fresh_workspace

    layout = P.new_layout(spark, fresh_workspace(spark, "slices"), 64, namespace="slices_")
    first = [(2019, f"N{i}", "KINGS", "M", 5, T1) for i in range(600)]
    P.run_all(spark, layout, FD.RUN_1, 1, bronze_rows=bronze(spark, first, FD.RUN_1))
    second = [(2019, "N7", "KINGS", "M", 50, T2), (2019, "NEW", "KINGS", "M", 1, T2)]
    reports = P.run_all(spark, layout, FD.RUN_2, 2, bronze_rows=bronze(spark, second, FD.RUN_2))
    return layout, reports


def test_a_small_run_writes_the_slices_it_touches(spark, runs):
    layout, _ = runs
    for base, rows in ((layout.silver, P.read_silver(spark, layout, 2)),
                       (layout.gold("fact"), P.read_gold(spark, layout, "fact", 2)),
                       (layout.mart("fact"), P.read_mart(spark, layout, "fact", 2))):
        first = written(local_path(TB.snapshot_path(base, 1)))
        second = written(local_path(TB.snapshot_path(base, 2)))
        assert len(first) > 60 and 1 <= len(second) <= 2, (base, second.keys())
        assert sum(map(len, second.values())) <= 2
        assert rows.count() == 601
        holders = TB.read_note(spark, base, 2)["from"]
        assert sorted(holders.values()).count(2) == len(second)


def test_carried_and_written_slices_make_the_same_table(spark, runs):
    layout, reports = runs
    found = P.read_silver(spark, layout, 2)
    assert {(r.first_name, r["count"]) for r in found.collect()} == (
        {(f"N{i}", 5) for i in range(600)} - {("N7", 5)} | {("N7", 50), ("NEW", 1)})
    whole = P.silver_merge(P.read_silver(spark, layout, 1), silver_rows(spark, [
        row(name="N7", county="KINGS", count=50, mod=T2), row(name="NEW", count=1, mod=T2)]))
    assert whole.select(*S.NATURAL_KEY, "count").exceptAll(
        found.select(*S.NATURAL_KEY, "count")).count() == 0
    counts = reports[1].metrics
    assert (counts["inserted"], counts["updated"], counts["carried"], counts["rows_out"]) == (1, 1, 599, 601)
    assert reports[2].metrics["fact"] == reports[3].metrics["fact"] == 601
    # Version 1 is as it was, and ids went on from the recorded number.
    assert P.read_silver(spark, layout, 1).where("first_name = 'NEW'").isEmpty()
    fact = P.read_gold(spark, layout, "fact", 2)
    assert fact.select("sid").distinct().count() == 601 and fact.agg(F.max("sid")).first()[0] == 600
    assert spark.read.table("slices_silver.new_york_baby_names").count() == 601
    assert spark.read.table("slices_mart." + S.MART_TABLE_NAMES["fact"][1]).count() == 601


def test_a_third_run_carries_from_two_versions(spark, runs):
    layout, _ = runs
    third = [(2019, "N9", "KINGS", "M", 90, T2)]
    merged = P.silver_merge(P.read_silver(spark, layout, 2), silver_rows(spark, [
        row(name="N9", count=90, mod=T2)]))
    hit = TB.slices_hit(silver_rows(spark, [row(name="N9")]), layout.silver_bucketing)
    part = merged.where(layout.silver_bucketing.slice_of().isin(hit))
    TB.write_snapshot(part, layout.silver, 3, bucketing=layout.silver_bucketing, deal=True,
                      carried=(2, hit), figures=lambda: {"rows": 601})
    found = P.read_silver(spark, layout, 3)
    assert set(TB.read_note(spark, layout.silver, 3)["from"].values()) == {1, 2, 3}
    assert {(r.first_name, r["count"]) for r in found.where("count <> 5").collect()} == {
        ("N7", 50), ("NEW", 1), ("N9", third[0][4])}
    # An application that has not seen the versions declares them again.
    for v in (1, 2, 3):
        spark.sql(f"DROP TABLE IF EXISTS {TB.snapshot_table(layout.silver, v)}")
    assert P.read_silver(spark, layout, 3).count() == 601


def test_a_merge_of_few_keys_lists_few_files(spark, runs):
    layout, _ = runs
    source = silver_rows(spark, [row(name="N7")])
    hit = TB.slices_hit(source, layout.silver_bucketing)
    assert len(hit) == 1
    plan = P.silver_merge(P.read_silver(spark, layout, 1, hit), source, target_buckets=64)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*slice#\d+ = {hit[0]}\)", text), text
    assert "Bucketed: true" in text


def test_planted_faults_in_changed_rows_fail_the_publish(spark, runs):
    layout, _ = runs
    changed = P.read_mart(spark, layout, "fact", 2).limit(5)
    P.require_sound_mart(spark, layout, 2, changed, [])
    orphan = changed.withColumn("nameSid", F.lit(99_999).cast("long"))
    with pytest.raises(ValueError, match="without member"):
        P.require_sound_mart(spark, layout, 2, orphan, [])
    bad = P.read_mart(spark, layout, "fact", 2)
    bad = bad.unionByName(bad.limit(1))
    TB.write_snapshot(bad, layout.mart("fact"), 7, bucketing=layout.mart_fact_bucketing, deal=True)
    for table in ("dim_names", "dim_years", "dim_locations"):
        TB.write_snapshot(P.read_mart(spark, layout, table, 2), layout.mart(table), 7)
    with pytest.raises(ValueError, match="repeated sid"):
        P.require_sound_mart(spark, layout, 7, changed, list(range(64)))
