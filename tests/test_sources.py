"""Edges: CSV quoting, lineage, modified-since scans, day slices, snapshots."""

from __future__ import annotations

import os
from datetime import date, datetime, timedelta, timezone

import pytest

from lakestar import schemas as S
from lakestar.functions.dates import RunContext, parse_day
from lakestar.session import local_path
from lakestar.sources import files as FS
from lakestar.sources import tables as TB


@pytest.mark.parametrize("rfc4180", [False, True])
def test_quoted_value_survives_roundtrip(spark, tmp_dir, rfc4180):
    rows = [(2019, 'St "X", Co', "KINGS", "F", 5), (2020, "plain", "back\\slash", "M", 7)]
    df = spark.createDataFrame(rows, S.LANDING_SCHEMA)
    FS.write_landing(df, tmp_dir, rfc4180=rfc4180)
    back = FS.read_landing(spark, tmp_dir, rfc4180=rfc4180)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    text = "".join(open(os.path.join(local_path(tmp_dir), f)).read()
                   for f in os.listdir(local_path(tmp_dir)) if f.endswith(".csv"))
    assert '"year","first_name"' in text  # header, every field quoted


def test_missing_measure_column_is_a_clear_failure(spark, tmp_dir):
    spark.createDataFrame([(2019, "A", "K", "F")], "year int, first_name string, county string, sex string") \
        .write.option("header", True).csv(tmp_dir)
    df = FS.read_landing(spark, tmp_dir, schema=None, infer=True)
    with pytest.raises(ValueError, match="name_count"):
        FS.require_columns(df)


def test_lineage_and_audit_columns(spark, tmp_dir):
    spark.createDataFrame([(2019, "A", "K", "F", 1)], S.LANDING_SCHEMA).write.option("header", True).csv(tmp_dir)
    ctx = RunContext.from_params("run-x", "21-05-2024 18:39:52")
    (r,) = FS.with_audit(FS.with_file_lineage(FS.read_landing(spark, tmp_dir)), ctx).collect()
    assert r[S.INPUT_FILENAME].endswith(".csv")
    assert isinstance(r[S.INPUT_MODIFIED], datetime)
    assert r[S.PROCESSING_DATE] == datetime(2024, 5, 21, 18, 39, 52)
    assert r[S.RUN_ID] == "run-x"


def test_modified_since_filters_by_file_time(spark, tmp_dir):
    spark.range(5).write.parquet(f"{tmp_dir}/a")
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    schema = spark.range(0).schema  # an empty window has no file to infer a schema from
    recent = FS.read_modified_since(spark, tmp_dir, now - timedelta(days=1), schema=schema)
    assert recent.count() == 5
    future = FS.read_modified_since(spark, tmp_dir, now + timedelta(days=1), schema=schema)
    assert future.count() == 0


def test_day_slice_reads_one_partition_and_pushes_bounds(spark, tmp_dir):
    rows = [(2019, "A", "K", "F", 1, datetime(2024, 5, 21, 23, 59, 59), "r1", "f", datetime(2024, 1, 1)),
            (2019, "A", "K", "F", 2, datetime(2024, 5, 22, 0, 0, 0), "r2", "f", datetime(2024, 1, 1))]
    TB.append_by_day(spark.createDataFrame(rows, S.BRONZE_SCHEMA), tmp_dir)
    day = TB.read_log_day(spark, tmp_dir, S.BRONZE_SCHEMA, date(2024, 5, 22))
    assert [r["name_count"] for r in day.collect()] == [2]
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_processing_day" in plan
    assert "GreaterThanOrEqual(_processing_date" in plan


def test_run_context_parses_both_formats():
    a = RunContext.from_params("r", "22-05-2024")
    b = RunContext.from_params("r", "22-05-2024 10:11:12")
    assert a.day == b.day == parse_day("22-05-2024") == date(2024, 5, 22)
    assert b.landing_filename == "nybabynames-22-05-2024.csv"
    assert b.modified_since == datetime(2024, 5, 21, 10, 11, 12)


def test_missing_snapshot_is_a_clear_failure(spark, tmp_dir):
    with pytest.raises(FileNotFoundError):
        TB.read_snapshot(spark, tmp_dir, 3)


def test_snapshot_rewrite_is_idempotent(spark, tmp_dir):
    df = spark.range(3)
    TB.write_snapshot(df, tmp_dir, 1)
    TB.write_snapshot(df, tmp_dir, 1)
    assert TB.read_snapshot(spark, tmp_dir, 1).count() == 3


def test_values_that_do_not_parse_keep_their_raw_text(spark, tmp_path):
    path = tmp_path / "landing.csv"
    path.write_text('year,first_name,county,sex,name_count\n"2001","a \\"b\\", c","x","F","12"\n'
                    '"n/a","d","y","M","1,5"\n"2003","e","","F",""\n')
    rows = sorted(FS.read_landing_rescued(spark, str(path)).collect(), key=lambda r: r.first_name)
    assert [(r.year, r.first_name, r.name_count) for r in rows] == [
        (2001, 'a "b", c', 12), (None, "d", None), (2003, "e", None)]
    assert [r[FS.RESCUED] for r in rows] == [None, {"year": "n/a", "name_count": "1,5"}, None]


def test_inferred_columns_are_brought_to_the_declared_schema(spark):
    found = spark.createDataFrame([("2001", 7.0, "more"), ("x", 8.0, None)],
                                  "year string, name_count double, other string")
    rows = FS.reconciled(found, S.LANDING_SCHEMA)
    assert [(f.name, f.dataType) for f in rows.schema] == [
        (f.name, f.dataType) for f in S.LANDING_SCHEMA]
    assert [tuple(r) for r in rows.collect()] == [(2001, None, None, None, 7),
                                                  (None, None, None, None, 8)]
    assert FS.schema_differences(found.schema, S.LANDING_SCHEMA) == [
        ("first_name", "missing"), ("county", "missing"), ("sex", "missing"), ("other", "extra"),
        ("year", "string for int"), ("name_count", "double for int")]
