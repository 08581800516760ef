"""The buckets of the merged tables: read in place, kept right, able to grow."""

from __future__ import annotations

import pytest

from helpers import SF0001
from helpers import T1, T2, row, silver_rows
from lakestar import schemas as S
from lakestar.plans import medallion as P
from lakestar.sources import tables as TB


def _ancestors(plan: str, marker: str) -> list[str]:
    """Operator lines above the first line containing ``marker`` (nearest first)."""
    lines = plan.split("== Initial Plan ==")[0].splitlines()
    idx = next(i for i, line in enumerate(lines) if marker in line)
    depth = len(lines[idx]) - len(lines[idx].lstrip(" :|+-"))
    out = []
    for line in reversed(lines[:idx]):
        d = len(line) - len(line.lstrip(" :|+-"))
        if d < depth:
            out.append(line.strip(" :|+-"))
            depth = d
    return out


def test_bucketed_target_is_read_in_place(spark):
    from lakestar.operators import quality as Q
    from lakestar.plans.medallion import silver_merge
    from lakestar.plans.scenario import Scenario
    from lakestar.sources import feed as FD

    sc = Scenario.of(spark, SF0001)
    assert sc.layout.buckets >= 8
    survivors = Q.latest_per_key(Q.quality_filter(Q.rename_measure(sc.bronze_day(FD.RUN_2))))
    df = silver_merge(sc.silver(1), survivors, target_buckets=sc.layout.buckets)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    path = _ancestors(plan, "Bucketed: true")
    join = next(i for i, op in enumerate(path) if "SortMergeJoin" in op)
    assert not any("Exchange" in op for op in path[:join]), path[:join]


def names(spark, n, run="run-1", mod=T1):
    return silver_rows(spark, [row(name=f"N{i}", run=run, mod=mod) for i in range(n)])


def test_reading_with_another_bucket_count_is_refused(spark, tmp_dir):
    four = TB.Bucketing(S.NATURAL_KEY, 4)
    TB.write_snapshot(names(spark, 200), f"{tmp_dir}/t", 1, bucketing=four, deal=True)
    schema = P.SILVER_SCHEMA
    assert TB.stored_buckets(spark, f"{tmp_dir}/t", 1) == 4
    with pytest.raises(ValueError, match="4 buckets, not 2"):
        TB.read_snapshot(spark, f"{tmp_dir}/t", 1, schema, TB.Bucketing(S.NATURAL_KEY, 2))
    found = TB.read_snapshot(spark, f"{tmp_dir}/t", 1, schema, TB.Bucketing(S.NATURAL_KEY, None))
    assert found.groupBy(*S.NATURAL_KEY).count().count() == 200
    assert found.join(names(spark, 200).select(*S.NATURAL_KEY), list(S.NATURAL_KEY)).count() == 200


def test_a_root_grows_its_buckets_and_keeps_every_row(spark, tmp_dir):
    layout = P.new_layout(spark, tmp_dir, 2)
    TB.write_snapshot(names(spark, 3), layout.silver, 1, bucketing=layout.silver_bucketing, deal=True)
    grown = P.new_layout(spark, tmp_dir, default_buckets=15)
    assert grown.buckets == 16 and P.new_layout(spark, tmp_dir).buckets == 16
    before = grown.target_buckets(spark, grown.silver, 1)
    merged = P.silver_merge(P.read_silver(spark, grown, 1), names(spark, 500, "run-2", T2),
                            target_buckets=before)
    TB.write_snapshot(merged, grown.silver, 2, bucketing=grown.silver_bucketing,
                      deal=before != grown.buckets)
    after = P.read_silver(spark, grown, 2)
    assert before == 2 and TB.stored_buckets(spark, grown.silver, 2) == 16
    assert after.count() == 500 and after.select(*S.NATURAL_KEY).distinct().count() == 500
    # The next merge runs over all buckets.
    again = P.silver_merge(after, names(spark, 900), target_buckets=16)
    assert again.count() == 900 and len(set(after.inputFiles())) > 8


def test_a_failed_read_of_the_layout_is_no_new_root(spark, tmp_dir):
    P.new_layout(spark, tmp_dir, 4)
    with pytest.raises(ValueError):
        P.new_layout(spark, tmp_dir, 6)
    spark.range(1).write.mode("overwrite").parquet(f"{tmp_dir}/_layout")
    with pytest.raises(Exception):  # noqa: B017 - whatever the damaged record gives
        P.new_layout(spark, tmp_dir)
