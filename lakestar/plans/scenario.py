"""The two-run history that the registered queries read.

Run 1 lands the first batch of the derived feed and takes it through every layer; run 2
lands the second batch the next day and merges it into what run 1 wrote.  The history is
written into the shared folder once per application and state of the input files: a query
that finds any input file replaced, added or removed builds a new one.
"""

from __future__ import annotations

import threading
import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestar import schemas as S
from lakestar.plans import medallion as P
from lakestar.session import workspace
from lakestar.sources import feed as FD
from lakestar.sources import tables as TB

_LOCK = threading.Lock()
_CACHE: dict[tuple, Scenario] = {}

FEED_TABLES = ("lineitem", "orders", "customer", "nation", "part")


def input_state(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    """(files, bytes, digest of paths, sizes and times) of the feed's input files.

    A listing only: no file is opened, and one row reaches the driver.
    """
    files = [spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(f"{sf_dir.rstrip('/')}/{t}.parquet").select("path", "length", "modificationTime")
             for t in FEED_TABLES]
    row = reduce(DataFrame.unionByName, files).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.coalesce(F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.lit(0)).alias("d"),
    ).first()
    return row["n"], row["bytes"], row["d"]


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Scenario:
    def __init__(self, spark: SparkSession, sf_dir: str, layout: P.Layout):
        self.spark = spark
        self.sf_dir = sf_dir
        self.layout = layout
        self.reports: list = []
        #: When the second run began: every file of run 1 is older (UTC).
        self.second_run_began: datetime | None = None

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Scenario:
        state = input_state(spark, sf_dir)
        key = (spark.sparkContext.applicationId, sf_dir, state)
        with _LOCK:
            if key not in _CACHE:
                name = uuid.uuid4().hex[:12]
                layout = P.new_layout(spark, workspace(spark, "history", name),
                                      default_buckets=P.buckets_for(spark, state[1]),
                                      namespace=f"h{name}_")
                sc = cls(spark, sf_dir, layout)
                sc._build()
                _CACHE[key] = sc
            return _CACHE[key]

    def feed(self) -> DataFrame:
        return FD.names_feed(self.spark, self.sf_dir)

    def _build(self) -> None:
        feed = self.feed()
        for version, ctx in enumerate(FD.RUNS, start=1):
            self.second_run_began = _now()
            self.reports += P.run_all(self.spark, self.layout, ctx, version,
                                      bronze_rows=FD.run_rows(feed, ctx))

    # -- readers -----------------------------------------------------------------
    def bronze(self) -> DataFrame:
        return P.read_bronze(self.spark, self.layout)

    def bronze_day(self, ctx) -> DataFrame:
        return TB.read_log_day(self.spark, self.layout.bronze, S.BRONZE_SCHEMA, ctx.day)

    def silver(self, version: int) -> DataFrame:
        return P.read_silver(self.spark, self.layout, version)

    def silver_day(self, version: int, ctx) -> DataFrame:
        return TB.day_slice(self.silver(version), ctx.day)

    def errors(self) -> DataFrame:
        return P.read_errors(self.spark, self.layout)

    def gold(self, table: str, version: int) -> DataFrame:
        return P.read_gold(self.spark, self.layout, table, version)

    def gold_dims(self, version: int) -> dict[str, DataFrame]:
        return {t: self.gold(t, version) for t in P.GOLD_TABLES if t != "fact"}

    def mart(self, table: str, version: int) -> DataFrame:
        return P.read_mart(self.spark, self.layout, table, version)
