"""Bronze -> silver cleaning on hand-made edge rows."""

from __future__ import annotations

import pytest

from helpers import T1, T2, as_set, row, silver_rows
from lakestar.operators import quality as Q


def test_null_rule_sends_every_invalid_row_to_errors(spark):
    rows = [
        row(year=None), row(name=None), row(county=None), row(sex=None), row(count=None),
        row(count=0), row(count=-1),
    ]
    df = silver_rows(spark, rows)
    survivors, errors = Q.clean(df)
    assert survivors.count() == 0
    assert errors.count() == len(rows)


def test_latest_file_wins_and_older_goes_to_errors(spark):
    df = silver_rows(spark, [row(count=3, mod=T1), row(count=9, mod=T2)])
    survivors, errors = Q.clean(df)
    assert as_set(survivors, ["count"]) == {(9,)}
    assert as_set(errors, ["count"]) == {(3,)}


def test_tie_on_time_keeps_smaller_count(spark):
    df = silver_rows(spark, [row(count=7, mod=T2), row(count=5, mod=T2)])
    survivors, errors = Q.clean(df)
    assert as_set(survivors, ["count"]) == {(5,)}
    assert as_set(errors, ["count"]) == {(7,)}


def test_exact_copy_of_survivor_is_kept_once_and_not_an_error(spark):
    df = silver_rows(spark, [row(), row()])
    survivors, errors = Q.clean(df)
    assert survivors.count() == 1
    assert errors.count() == 0


def test_exact_copies_of_invalid_row_collapse_to_one_error(spark):
    df = silver_rows(spark, [row(name=None), row(name=None)])
    survivors, errors = Q.clean(df)
    assert survivors.count() == 0
    assert errors.count() == 1


def test_full_tie_is_deterministic(spark):
    # Same key, time and count: the remaining columns decide (file name ascending).
    df = silver_rows(spark, [row(file="b.csv"), row(file="a.csv")])
    survivors, _ = Q.clean(df)
    assert as_set(survivors, ["_input_filename"]) == {("a.csv",)}


def test_quarantine_reason(spark):
    df = silver_rows(spark, [row(count=0), row(count=3, mod=T1), row(count=4, mod=T2)])
    survivors, errors = Q.clean(df)
    reasons = as_set(Q.quarantine_reason(errors), ["count", "reason"])
    assert reasons == {(0, "invalid"), (3, "superseded")}


def test_rename_measure_fails_loudly_when_missing(spark):
    df = spark.createDataFrame([(1,)], "year int")
    with pytest.raises(ValueError, match="name_count"):
        Q.rename_measure(df)


def test_latest_per_key_plans_group_limit_before_shuffle(spark):
    df = silver_rows(spark, [row()])
    plan = Q.latest_per_key(Q.quality_filter(df))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
