"""Mart copy, de-duplication, upsert and key checks."""

from __future__ import annotations

import pytest

from helpers import as_set
from lakestar import schemas as S
from lakestar.functions.casting import copy_mapped
from lakestar.operators import mart as M


def test_string_sid_converts_or_becomes_null(spark):
    df = spark.createDataFrame([("12",), ("-1",), ("abc",)], "locationSid string")
    out = copy_mapped(df, [("locationSid", "locationSid", "bigint", None)])
    assert sorted((r[0] for r in out.collect()), key=lambda v: (v is None, v)) == [-1, 12, None]


def test_over_long_name_is_cut(spark):
    df = spark.createDataFrame([(0, "x" * 300, "MALE-SEX-TOO-LONG")], "sid long, first_name string, sex string")
    (r,) = M.mart_copy(df, "dim_names").collect()
    assert len(r["first_name"]) == 265 and len(r["sex"]) == 10


def test_boolean_is_not_a_number(spark):
    df = spark.createDataFrame([(True,)], "flag boolean")
    (r,) = copy_mapped(df, [("flag", "n", "int", None)]).collect()
    assert r["n"] is None


def test_republish_overwrites_and_never_deletes(spark):
    cur = spark.createDataFrame([(1, "A", "F"), (2, "B", "M")], "sid long, first_name string, sex string")
    src = spark.createDataFrame([(1, "Z", "F"), (3, "C", "M")], "sid long, first_name string, sex string")
    out = M.upsert(cur, src)
    assert as_set(out) == {(1, "Z", "F"), (2, "B", "M"), (3, "C", "M")}


def test_upsert_refuses_ambiguous_sid(spark):
    src = spark.createDataFrame([(1, "A", "F"), (1, "B", "F")], "sid long, first_name string, sex string")
    with pytest.raises(ValueError):
        M.upsert(None, src)


def test_rownum_keeps_newest_version(spark):
    from helpers import P1, P2

    gold = spark.createDataFrame(
        [(5, 0, 0, 0, 3, "k", "v1", "run-1", P1), (5, 0, 0, 0, 8, "k", "v2", "run-2", P2)],
        S.FACT_SCHEMA,
    )
    (r,) = M.mart_source(gold, "fact", dedup="rownum").collect()
    assert r["count"] == 8
    # A distinct over the two versions leaves the sid twice: the pk check reports it.
    distinct = M.mart_source(gold, "fact", dedup="distinct")
    assert as_set(M.pk_violations(distinct)) == {(5, 2)}


def test_fk_orphans_reported(spark):
    fact = spark.createDataFrame([(0, 0, 0, 0, 1), (1, 9, 0, -1, 1)],
                                 "sid long, nameSid long, yearSid long, locationSid long, count int")
    dims = {
        "dim_names": spark.createDataFrame([(0,)], "sid long"),
        "dim_years": spark.createDataFrame([(0,)], "sid long"),
        "dim_locations": M.with_unknown_member(
            spark.createDataFrame([(0, "K")], "sid long, county string")),
    }
    got = as_set(M.fk_orphans(fact, dims), ["fk_column", "orphan_rows"])
    assert got == {("nameSid", 1), ("yearSid", 0), ("locationSid", 0)}


def test_unknown_member_added_once(spark):
    d = spark.createDataFrame([(0, "K")], "sid long, county string")
    once = M.with_unknown_member(d)
    twice = M.with_unknown_member(once)
    assert as_set(twice) == {(0, "K"), (-1, None)}


def test_compaction_splits_a_hot_key(spark):
    from pyspark.sql import functions as F

    from lakestar.operators.maintenance import compacted

    # One key holds 60% of the rows.
    df = spark.range(0, 1000).select(
        F.when(F.col("id") < 600, F.lit(0)).otherwise(F.col("id")).alias("k"), "id")
    out = compacted(df, 4, ["k"])
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p"))
             .agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 1000 and max(sizes) < 600
