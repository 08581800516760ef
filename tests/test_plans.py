"""Physical-plan checks: the plans the operators are meant to produce."""

from __future__ import annotations

import re

from helpers import SF0001
from helpers import T1, T2, row, silver_rows
from lakestar.operators import quality as Q
from lakestar.operators import reports as R
from lakestar.operators import star as G
from lakestar.plans.medallion import silver_merge
from lakestar.sources import feed as FD


def plan_of(df) -> str:
    df.collect()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_shuffle_merge_is_one_full_outer_join(spark):
    t = silver_rows(spark, [row(name="A", mod=T1)])
    s = silver_rows(spark, [row(name="A", mod=T2)])
    df = silver_merge(t, s)
    logical = df._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("Join FullOuter") == 1


def test_small_dimensions_are_broadcast_by_the_planner(spark):
    rows = silver_rows(spark, [row()])
    dims = {
        "dim_names": spark.createDataFrame([(0, "ABEL", "M")], "sid long, first_name string, sex string"),
        "dim_years": spark.createDataFrame([(0, 2019)], "sid long, year int"),
        "dim_locations": spark.createDataFrame([(0, "KINGS")], "sid long, county string"),
    }
    plan = plan_of(G.fact_rows(rows, dims))
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in final


def test_quarantine_collapses_copies_before_its_only_shuffle(spark):
    df = silver_rows(spark, [row(), row(), row(count=0), row(count=0)])
    errors = Q.quarantine(df, Q.latest_per_key(Q.quality_filter(df)))
    final = plan_of(errors).split("== Initial Plan ==")[0]
    assert "Join" not in final
    # Above the window of the survivors there is one exchange, over a partial aggregation.
    lines = [re.sub(r"#\d+L?", "", line) for line in final.splitlines()]
    union = next(i for i, line in enumerate(lines) if "Union" in line)
    above = [i for i in range(union) if "Exchange hashpartitioning" in lines[i]]
    assert len(above) == 1 and "HashAggregate" in lines[above[0] + 1]
    assert sorted(r["count"] for r in errors.collect()) == [0]


def test_feed_prunes_columns_and_pushes_run_filter(spark):
    feed = FD.run_rows(FD.names_feed(spark, SF0001), FD.RUN_2)
    plan = feed._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint" in plan
    assert "l_extendedprice" not in plan and "l_discount" not in plan


def test_top_report_is_a_top_k(spark):
    fact = spark.createDataFrame([(0, 0, 0, 0, 5)], "sid long, nameSid long, yearSid long, locationSid long, count int")
    names = spark.createDataFrame([(0, "A", "R")], "sid long, first_name string, sex string")
    years = spark.createDataFrame([(0, 1998)], "sid long, year int")
    df = R.top_names(spark, fact, names, years, "R", 1998, 10)
    assert "TakeOrderedAndProject" in plan_of(df)
    assert [tuple(r) for r in df.collect()] == [("A", 5)]


def test_one_year_report_prunes_the_fact_by_year(spark):
    from lakestar.plans.scenario import Scenario

    sc = Scenario.of(spark, SF0001)
    df = R.top_names(spark, sc.mart("fact", 2), sc.mart("dim_names", 2), sc.mart("dim_years", 2),
                     "R", 1998, 10)
    final = plan_of(df).split("== Initial Plan ==")[0]
    fact_scan = next(line for line in final.splitlines()
                     if "FileScan" in line and "yearSid" in line and "nameSid" in line)
    assert "PartitionFilters: [isnotnull(yearSid" in fact_scan
    assert "dynamicpruning" in final
