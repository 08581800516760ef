"""Incremental landing ingest: each file is ingested once, across runs."""

from __future__ import annotations

from helpers import SF0001
from lakestar import schemas as S
from lakestar.sources import feed as FD
from lakestar.sources import files as FS
from lakestar.sources import tables as TB
from lakestar.streaming import ingest_landing


def test_ingest_reads_each_landing_file_once(spark, tmp_dir):
    feed = FD.names_feed(spark, SF0001)
    landing, bronze, ckpt = f"{tmp_dir}/landing", f"{tmp_dir}/bronze", f"{tmp_dir}/_ckpt"
    run1 = FD.landing_rows(FD.run_rows(feed, FD.RUN_1))
    run2 = FD.landing_rows(FD.run_rows(feed, FD.RUN_2))

    FS.write_landing(run1, f"{landing}/{FD.FILE_1}")
    ingest_landing(spark, f"{landing}/*", bronze, ckpt, FD.RUN_1, timeout_sec=300)
    n1 = TB.read_log(spark, bronze, S.BRONZE_SCHEMA).count()
    assert n1 == run1.count()

    # Same run again, no new file: nothing is added.
    ingest_landing(spark, f"{landing}/*", bronze, ckpt, FD.RUN_1, timeout_sec=300)
    assert TB.read_log(spark, bronze, S.BRONZE_SCHEMA).count() == n1

    # Next run: only the new file's rows, stamped with the new run.
    FS.write_landing(run2, f"{landing}/{FD.FILE_2}")
    ingest_landing(spark, f"{landing}/*", bronze, ckpt, FD.RUN_2, timeout_sec=300)
    out = TB.read_log(spark, bronze, S.BRONZE_SCHEMA)
    assert out.count() == n1 + run2.count()
    by_run = {r[S.RUN_ID]: r["count"] for r in out.groupBy(S.RUN_ID).count().collect()}
    assert by_run == {FD.RUN_1.run_id: n1, FD.RUN_2.run_id: run2.count()}
    # The day slice of the new run reads its own partition only.
    assert TB.read_log_day(spark, bronze, S.BRONZE_SCHEMA, FD.RUN_2.day).count() == run2.count()


def test_batch_and_streamed_runs_share_a_folder(spark, tmp_dir):
    from lakestar.plans import medallion as P

    layout = P.new_layout(spark, tmp_dir)
    feed = FD.names_feed(spark, SF0001)
    first, second = (FD.landing_rows(FD.run_rows(feed, ctx)) for ctx in FD.RUNS)
    FS.write_landing(first, layout.landing(FD.FILE_1))
    ingest_landing(spark, f"{tmp_dir}/landing/*", layout.bronze, f"{tmp_dir}/_ckpt", FD.RUN_1, 300)
    FS.write_landing(second, f"{tmp_dir}/other/{FD.FILE_2}")
    P.landing_to_bronze(spark, layout, FD.RUN_2, f"{tmp_dir}/other/{FD.FILE_2}")
    assert P.read_bronze(spark, layout).count() == first.count() + second.count()
    assert P.compact_day(spark, layout, FD.RUN_1.day) >= 1
    # A repeated batch of the same run adds nothing: its files are already there.
    ingest_landing(spark, f"{tmp_dir}/landing/*", layout.bronze, f"{tmp_dir}/_ckpt2", FD.RUN_1, 300)
    assert P.read_bronze(spark, layout).count() == first.count() + second.count()
