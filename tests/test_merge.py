"""Generic merge: newer-wins (silver), hash-change (gold), upsert (mart)."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import P1, P2, T1, T2, as_set, row, silver_rows
from lakestar.operators import merging as MG
from lakestar.plans.medallion import silver_merge


def _merge(spark, target_rows, source_rows, buckets):
    return silver_merge(silver_rows(spark, target_rows), silver_rows(spark, source_rows),
                        with_action=True, target_buckets=buckets)


BUCKETS = [None, 4]


@pytest.mark.parametrize("buckets", BUCKETS)
def test_equal_time_leaves_target_unchanged(spark, buckets):
    out = _merge(spark, [row(count=1, mod=T1)], [row(count=2, mod=T1, run="run-2")], buckets)
    assert as_set(out, ["count", "_pipeline_run_id", "_action"]) == {(1, "run-1", "unchanged")}


@pytest.mark.parametrize("buckets", BUCKETS)
def test_older_source_leaves_target_unchanged(spark, buckets):
    out = _merge(spark, [row(count=1, mod=T2)], [row(count=2, mod=T1)], buckets)
    assert as_set(out, ["count", "_action"]) == {(1, "unchanged")}


@pytest.mark.parametrize("buckets", BUCKETS)
def test_newer_source_updates_measure_and_control_columns(spark, buckets):
    out = _merge(spark, [row(count=1, mod=T1)],
                 [row(count=2, mod=T2, pd=P2, run="run-2", file="g.csv")], buckets)
    assert as_set(out, ["count", "_processing_date", "_pipeline_run_id", "_input_filename",
                        "_input_file_modification_date", "_action"]) == {
        (2, P2, "run-2", "g.csv", T2, "update")}


@pytest.mark.parametrize("buckets", BUCKETS)
def test_null_key_never_matches(spark, buckets):
    out = _merge(spark, [row(county=None, count=1)], [row(county=None, count=2, mod=T2)], buckets)
    assert sorted(r["_action"] for r in out.collect()) == ["carried", "insert"]


@pytest.mark.parametrize("buckets", BUCKETS)
def test_unmatched_rows_are_kept_and_inserted(spark, buckets):
    out = _merge(spark, [row(name="A")], [row(name="B")], buckets)
    assert as_set(out, ["first_name", "_action"]) == {("A", "carried"), ("B", "insert")}


def test_null_guard_means_no_update(spark):
    t = spark.createDataFrame([(1, None, "x")], "k int, h string, v string")
    s = spark.createDataFrame([(1, "a", "y")], "k int, h string, v string")
    out = MG.merge(t, s, ["k"], update_when=lambda tt, ss: ss("h") != tt("h"), update_set=["v"],
                   with_action=True)
    assert as_set(out, ["v", "_action"]) == {("x", "unchanged")}


def test_repeated_source_key_fails(spark):
    t = spark.createDataFrame([(1, "x")], "k int, v string")
    s = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="repeated keys"):
        MG.merge(t, s, ["k"], update_set=["v"])


def test_first_load_inserts_everything(spark):
    s = silver_rows(spark, [row(name="A"), row(name="B")])
    out = silver_merge(None, s, with_action=True)
    assert as_set(out, ["first_name", "_action"]) == {("A", "insert"), ("B", "insert")}


def test_merge_metrics(spark):
    out = _merge(spark, [row(name="A", mod=T1), row(name="B"), row(name="C")],
                 [row(name="A", mod=T2), row(name="B"), row(name="D")], None)
    m = MG.merge_metrics(out).first().asDict()
    assert m == {"inserted": 1, "updated": 1, "unchanged": 1, "carried": 1, "rows_out": 4}


_rows = st.lists(
    st.tuples(st.sampled_from(["A", "B", "C", "D"]), st.sampled_from(["F", "M"]),
              st.integers(1, 9), st.sampled_from([T1, T2])),
    max_size=8,
)


def _to_silver(spark, items, run, pd):
    seen, out = set(), []
    for name, sex, cnt, mod in items:
        if (name, sex) in seen:
            continue  # one row per key, as survivors are
        seen.add((name, sex))
        out.append(row(name=name, sex=sex, count=cnt, mod=mod, run=run, pd=pd))
    return silver_rows(spark, out)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(target=_rows, source=_rows)
def test_bucketing_changes_no_row_and_merge_is_idempotent(spark, target, source):
    t = _to_silver(spark, target, "run-1", P1)
    s = _to_silver(spark, source, "run-2", P2)
    a = silver_merge(t, s)
    b = silver_merge(t, s, target_buckets=3)
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    # Merging the same batch again changes nothing.
    again = silver_merge(a, s)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, a.collect()), key=repr)
    # No key is lost: every target and source key is present.
    keys = {(r["first_name"], r["sex"]) for r in a.collect()}
    assert {(n, x) for n, x, *_ in target} | {(n, x) for n, x, *_ in source} == keys
    assert a.count() == len(keys)
