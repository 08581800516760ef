"""Benchmark: the whole two-run flow plus the reports, at one scale.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8).
Prints one JSON line: total seconds and per-step seconds.  Steps:

* ``feed``            - derive both runs' landing rows from the test tables (5-way join);
* ``landing_csv``     - write run 1's landing rows as an all-quoted CSV;
* ``bronze_ingest``   - CSV scan + lineage + audit columns + append (run 1);
* ``run1_bronze`` / ``run2_bronze`` - append the derived rows for each run;
* ``runN_silver``     - slice, quality, latest-per-key, quarantine, newer-wins merge;
* ``runN_gold``       - three dimension merges with identity, SID lookups, fact merge;
* ``runN_mart``       - typed copy, one row per sid, upsert, unknown members;
* ``report_*``        - the analyst reports over the published mart.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from lakestar.operators import reports as R  # noqa: E402
from lakestar.plans import medallion as P  # noqa: E402
from lakestar.session import fresh_workspace, get_session  # noqa: E402
from lakestar.sources import feed as FD  # noqa: E402
from lakestar.sources import files as FS  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus,
                        conf={"spark.driver.memory": "4g",
                              # Local disk: opening a file is cheap, so small inputs split
                              # over all cores instead of packing into 4 MB splits.
                              "spark.sql.files.openCostInBytes": str(1 << 20)})
    timings: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        timings[name] = round(time.perf_counter() - t0, 3)
        return out

    t_start = time.perf_counter()
    layout = P.new_layout(spark, fresh_workspace(spark, "bench"))
    feed_path = f"{layout.root}/feed"
    timed("feed", lambda: FD.names_feed(spark, sf_dir).write.mode("overwrite").parquet(feed_path))
    feed = spark.read.parquet(feed_path)

    # Edge: landing CSV -> bronze through file scan and lineage (separate bronze table).
    edge = P.Layout(f"{layout.root}/edge")
    landing = edge.landing(FD.FILE_1)
    timed("landing_csv", lambda: FS.write_landing(FD.landing_rows(FD.run_rows(feed, FD.RUN_1)),
                                                  landing))
    timed("bronze_ingest", lambda: P.landing_to_bronze(spark, edge, FD.RUN_1, landing))

    for version, ctx in enumerate(FD.RUNS, start=1):
        previous = version - 1 if version > 1 else None
        tag = f"run{version}"
        timed(f"{tag}_bronze", lambda: P.append_bronze(FD.run_rows(feed, ctx), layout))
        timed(f"{tag}_silver", lambda: P.bronze_to_silver(spark, layout, ctx, previous, version))
        timed(f"{tag}_gold", lambda: P.silver_to_gold(spark, layout, ctx, version, previous,
                                                      version))
        timed(f"{tag}_mart", lambda: P.gold_to_mart(spark, layout, ctx, version, previous,
                                                      version))

    fact = P.read_mart(spark, layout, "fact", 2)
    names = P.read_mart(spark, layout, "dim_names", 2)
    years = P.read_mart(spark, layout, "dim_years", 2)
    timed("report_top10", lambda: R.top_names(spark, fact, names, years, "R", 1998, 10).collect())
    timed("report_name_by_year",
          lambda: R.name_by_year(spark, fact, names, years, "red widget").collect())
    timed("report_top10_silver",
          lambda: R.top_names_silver(spark, P.read_silver(spark, layout, 2), 10).collect())
    total = round(time.perf_counter() - t_start, 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "medallion_two_runs_total", "value": total, "unit": "sec",
                      "queries": timings, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
