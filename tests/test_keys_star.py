"""Surrogate keys, dimension/fact merges, unknown members, key hashes."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import P1, P2, as_set, row, silver_rows
from lakestar import schemas as S
from lakestar.functions.hashing import COMPAT, EXACT, sha256_of
from lakestar.operators import keys as K
from lakestar.operators import star as G


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_range_numbering_equals_global_row_number(spark, partitions):
    df = spark.range(0, 500).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id"))
    got = K.assign_sid(df, ["k", "id"], start=10, num_partitions=partitions)
    expected = df.select(
        (F.row_number().over(Window.orderBy("k", "id")) + 9).cast("long").alias("sid"), "k", "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_next_sid(spark):
    assert K.next_sid(None) == 0
    assert K.next_sid(spark.createDataFrame([(4,), (9,)], "sid long")) == 10
    assert K.next_sid(spark.createDataFrame([], "sid long")) == 0


def _silver(spark, names, run, pd):
    return silver_rows(spark, [row(name=n, run=run, pd=pd) for n in names])


def test_sid_start_and_growth_keep_old_ids(spark):
    first = G.merge_star(None, G.delta(_silver(spark, ["C", "A", "B"], "run-1", P1), G.DIM_NAMES),
                         G.DIM_NAMES)
    assert as_set(first, ["sid", "first_name"]) == {(0, "A"), (1, "B"), (2, "C")}
    second = G.merge_star(first, G.delta(_silver(spark, ["E", "A", "D"], "run-2", P2), G.DIM_NAMES),
                          G.DIM_NAMES)
    got = {(r["sid"], r["first_name"], r["_pipeline_run_id"]) for r in second.collect()}
    # Known name: same sid, new control columns; new names: 3 and 4 in key order.
    assert got == {(0, "A", "run-2"), (1, "B", "run-1"), (2, "C", "run-1"),
                   (3, "D", "run-2"), (4, "E", "run-2")}


def test_dim_update_keeps_business_columns_and_sid(spark):
    first = G.merge_star(None, G.delta(_silver(spark, ["A"], "run-1", P1), G.DIM_NAMES),
                         G.DIM_NAMES)
    again = G.merge_star(first, G.delta(_silver(spark, ["A"], "run-2", P2), G.DIM_NAMES),
                         G.DIM_NAMES)
    (r,) = again.collect()
    assert (r["sid"], r["first_name"], r["sex"], r["_pipeline_run_id"], r["_processing_date"]) == (
        0, "A", "M", "run-2", P2)


def test_same_run_again_is_no_update(spark):
    first = G.merge_star(None, G.delta(_silver(spark, ["A"], "run-1", P1), G.DIM_NAMES),
                         G.DIM_NAMES)
    again = G.merge_star(first, G.delta(_silver(spark, ["A"], "run-1", P1), G.DIM_NAMES),
                         G.DIM_NAMES)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))


def test_unknown_member_gets_minus_one(spark):
    rows = silver_rows(spark, [row(county="NOWHERE")])
    dims = {
        "dim_names": spark.createDataFrame([(0, "ABEL", "M")], "sid long, first_name string, sex string"),
        "dim_years": spark.createDataFrame([(0, 2019)], "sid long, year int"),
        "dim_locations": spark.createDataFrame([(0, "KINGS")], "sid long, county string"),
    }
    (r,) = G.fact_rows(rows, dims).collect()
    assert (r["nameSid"], r["yearSid"], r["locationSid"]) == (0, 0, S.UNKNOWN_SID)


def test_key_collision_exact_vs_compat(spark):
    df = spark.createDataFrame([(1, 11, 1), (11, 1, 1)], "a long, b long, c long")
    exact = df.select(sha256_of(["a", "b", "c"], EXACT).alias("h")).distinct().count()
    compat = df.select(sha256_of(["a", "b", "c"], COMPAT).alias("h")).distinct().count()
    assert (exact, compat) == (2, 1)


def test_fact_delta_keeps_colliding_facts_apart(spark):
    facts = spark.createDataFrame(
        [(1, 11, 1, 5, "run-1", P1), (11, 1, 1, 6, "run-1", P1)],
        "nameSid long, yearSid long, locationSid long, count int, _pipeline_run_id string, "
        "_processing_date timestamp_ntz",
    )
    assert G.delta(facts, G.FACT, EXACT).count() == 2
    assert G.delta(facts, G.FACT, COMPAT).count() == 1


def test_exact_hash_handles_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, "a")], "x string, y string")
    hashes = {r["h"] for r in df.select(sha256_of(["x", "y"]).alias("h")).collect()}
    assert len(hashes) == 2 and None not in hashes


def test_single_pass_dimension_deltas_equal_per_dimension_deltas(spark):
    from helpers import SF0001
    from lakestar.plans.scenario import Scenario

    rows = Scenario.of(spark, SF0001).silver(2)
    single = G.dimension_deltas(rows)
    for spec in G.DIMS:
        a = single[spec.name]
        b = G.delta(rows, spec)
        cols = sorted(a.columns)
        assert sorted(cols) == sorted(b.columns)
        assert sorted(map(tuple, a.select(*cols).collect()), key=repr) == \
            sorted(map(tuple, b.select(*cols).collect()), key=repr)


def test_single_pass_breaks_ties_like_the_window(spark):
    # Same key, same date: the larger run id wins; a NULL date loses to any date.
    rows = silver_rows(spark, [row(name="A", run="run-1", pd=P2), row(name="A", run="run-9", pd=P2),
                               row(name="B", run="run-5", pd=None), row(name="B", run="run-1", pd=P1)])
    got = {r["first_name"]: r["_pipeline_run_id"]
           for r in G.dimension_deltas(rows)["dim_names"].collect()}
    want = {r["first_name"]: r["_pipeline_run_id"]
            for r in G.delta(rows, G.DIM_NAMES).collect()}
    assert got == want == {"A": "run-9", "B": "run-1"}
