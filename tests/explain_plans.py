"""Print the physical plans of the key operators (the tree part of explain("formatted")).

    python tests/explain_plans.py /root/testdata/sf0.01 > PLANS.md

Each plan is taken after the query ran, so adaptive decisions are final.  The "large"
variants force the at-scale shapes (broadcast bound 0, no automatic broadcast) on the
same data.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from lakestar import schemas as S  # noqa: E402
from lakestar.operators import keys as K  # noqa: E402
from lakestar.operators import mart as M  # noqa: E402
from lakestar.operators import quality as Q  # noqa: E402
from lakestar.operators import reports as R  # noqa: E402
from lakestar.operators import star as G  # noqa: E402
from lakestar.plans.medallion import silver_merge  # noqa: E402
from lakestar.plans.scenario import Scenario  # noqa: E402
from lakestar.session import get_session  # noqa: E402
from lakestar.sources import feed as FD  # noqa: E402

_NOISE = re.compile(r"#\d+L?|\[plan_id=\d+\]")


def tree(df) -> str:
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    lines = [_NOISE.sub("", line)[:150].rstrip() for line in final.splitlines()]
    return "\n".join(line for line in lines if line.strip() and "Final Plan" not in line)


def section(title: str, note: str, df) -> None:
    print(f"## {title}\n\n{note}\n\n```\n{tree(df)}\n```\n", flush=True)


def main(sf_dir: str) -> None:
    spark = get_session("local[8]", shuffle_partitions=8)
    sc = Scenario.of(spark, sf_dir)
    print(f"# Physical plans (sf = {os.path.basename(sf_dir)}, local[8], 8 shuffle partitions)\n")
    print("Generated by `python tests/explain_plans.py`; expression ids removed, long lines cut.\n")

    slice2 = sc.bronze_day(FD.RUN_2)
    section("Day slice of bronze (S5/F2)",
            "One partition directory (`PartitionFilters`), timestamp bounds pushed to Parquet.",
            slice2)
    survivors = Q.latest_per_key(Q.quality_filter(Q.rename_measure(slice2)))
    section("Latest row per key (W1)",
            "`WindowGroupLimit` on both sides of the exchange: a hot key is cut per map task.",
            survivors)
    section("Quarantine (E1)",
            "Slice and survivors grouped together: NULLs compare as equal, and the partial "
            "aggregation collapses copies before the exchange.",
            Q.quarantine(Q.rename_measure(slice2), survivors))
    section("Dimension deltas in one pass (A1 for the three dimensions)",
            "Grouping sets over the silver day slice: one scan, partial aggregation, one "
            "exchange; the aggregate is materialised and each dimension reads its rows.",
            G.dimension_members(sc.silver_day(2, FD.RUN_2)))
    dims = sc.gold_dims(2)
    section("SID lookups (J1/J2, F7)",
            "The planner broadcasts dimensions whose measured size allows it.",
            G.fact_rows(sc.silver_day(2, FD.RUN_2), dims))
    section("Report: top names (R1)",
            "Broadcast star join, partial + final aggregation, top-k.",
            R.top_names(spark, sc.mart("fact", 2), sc.mart("dim_names", 2),
                        sc.mart("dim_years", 2), "R", 1998, 10))
    section("Foreign-key orphans (J6)",
            "Per-value partial aggregation before the anti join.",
            M.fk_orphans(G.lookup_sids(sc.silver_day(2, FD.RUN_2), sc.gold_dims(1)),
                         sc.gold_dims(1)))

    for key, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"),
                       ("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(key, value)
    section("Newer-wins merge (M1, bucketed target)",
            "The target is a bucketed scan read in place; only the source is exchanged, into "
            "the target's buckets.",
            silver_merge(sc.silver(1), survivors, target_buckets=sc.layout.buckets))
    keys = sc.silver(2).select(*S.NATURAL_KEY)
    section("Surrogate ids, large input (M4)",
            "Numbering reads the range-partitioned checkpoint; the offsets (one row per "
            "partition) are broadcast.  No single-partition exchange.",
            K.assign_sid(keys, list(S.NATURAL_KEY), num_partitions=8))
    section("Report: top names without broadcasts",
            "What the star join becomes when no dimension may be broadcast.",
            R.top_names(spark, sc.mart("fact", 2), sc.mart("dim_names", 2),
                        sc.mart("dim_years", 2), "R", 1998, 10))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
