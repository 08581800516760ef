"""Work that must not be done again, or on more rows than it needs, as the input grows."""

from __future__ import annotations

import os
import random
from datetime import datetime

from helpers import P1, P2, SF0001, T1, T2, as_set, row, silver_rows
from lakestar import schemas as S
from lakestar.operators import quality as Q
from lakestar.plans import medallion as P
from lakestar.session import local_path
from lakestar.sources import feed as FD
from lakestar.sources import tables as TB


def test_first_run_drops_the_second_runs_rows_before_the_joins(spark):
    rows = FD.run_rows(FD.names_feed(spark, SF0001), FD.RUN_1)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 4 and not any("%" in line or "CASE" in line for line in joins), joins
    assert "Filter" not in plan.split("Join Inner")[0]
    both = FD.names_feed(spark, SF0001)
    assert rows.count() + FD.run_rows(both, FD.RUN_2).count() == both.count()


def test_compaction_guard_takes_its_rows_from_the_history(spark, monkeypatch):
    from lakestar.plans.catalog import QUERIES
    from lakestar.plans.scenario import Scenario

    Scenario.of(spark, SF0001)

    def joined_again(*_):
        raise AssertionError("the feed is joined again")

    monkeypatch.setattr(FD, "names_feed", joined_again)
    assert QUERIES["compaction_due"](spark, SF0001).count() == 10


def test_files_of_a_day_are_listed_not_read(spark, tmp_dir, monkeypatch):
    layout = P.Layout(tmp_dir, namespace="listed_")
    rows = FD.run_rows(FD.names_feed(spark, SF0001), FD.RUN_1)
    P.append_bronze(rows.repartition(5), layout)
    day = os.path.join(local_path(layout.bronze), f"_processing_day={FD.RUN_1.day}")
    stored = {f"file:{d}/{f}": os.path.getsize(f"{d}/{f}")
              for d, _, files in os.walk(day) for f in files if f.endswith(".parquet")}
    assert TB.day_files(spark, layout.bronze, FD.RUN_1.day) == stored and len(stored) == 5
    assert TB.day_files(spark, layout.bronze, FD.RUN_2.day) == {}
    monkeypatch.setattr(P.MT, "input_bytes", None)  # a scan for the files' sizes
    assert P.compact_day(spark, layout, FD.RUN_1.day) == 1


def test_latest_row_sorts_what_a_hash_aggregation_leaves(spark):
    df = silver_rows(spark, [row(count=3, mod=T1), row(count=9, mod=T2), row(count=8, mod=T2)])
    latest = Q.latest_per_key(Q.quality_filter(df))
    assert as_set(latest, ["count"]) == {(8,)}
    plan = latest._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    before_any_shuffle = plan.rsplit("Exchange", 1)[1]
    assert "HashAggregate" in before_any_shuffle and "Sort" not in before_any_shuffle, plan
    assert "SortAggregate" not in plan


def test_latest_row_is_the_windows_first_on_odd_rows(spark):
    rng = random.Random(5)
    times = [None, datetime(1, 1, 1), datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(1970, 1, 1),
             datetime(2024, 3, 31, 2, 30), datetime(2024, 3, 31, 3, 30), datetime(9999, 12, 31, 23, 59, 59, 999999)]
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, "A"]), rng.choice([None, "K"]), "M",
             rng.choice([None, 0, 1, -1, 5000, 2**31 - 1, -2**31]), rng.choice([None, P1, P2]),
             rng.choice([None, "r1", "r2"]), rng.choice([None, "f", "g"]), rng.choice(times))
            for _ in range(1500)]
    df = silver_rows(spark, rows).repartition(5)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # an hour that it skips is among the times
    try:
        for keys in (S.NATURAL_KEY, ("sex",), ("year", "first_name")):
            expected = Q.first_per_key(df, keys, Q.latest_order(df.columns, keys))
            found = Q.latest_per_key(df, keys)
            assert found.schema.simpleString() == expected.schema.simpleString()
            assert as_set(found) == as_set(expected) and found.count() == expected.count()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
