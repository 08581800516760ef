"""The pipeline's input shape, derived from the TPC-H-like test tables.

The original input (a public baby-names file) is not available offline, so the landing
rows are derived from ``lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ part``: order year ->
``year``, part name -> ``first_name``, nation name -> ``county``, return flag -> ``sex``,
quantity -> ``name_count``, ship date -> file modification time.  Two runs are split by
order key, and invalid rows are injected by key arithmetic so every quality branch fires.

Join order is chosen for size: the orders-sized side (orders ⋈ customer ⋈ nation) and the
lineitem-sized side (lineitem ⋈ part) are built separately and joined once on the order
key, so lineitem is shuffled twice instead of three times.  Broadcasts are left to
the planner and AQE, which know the measured sizes.

Run 2 also brings what run 1 lacks: names of one length class, one county and one year come
in run 2 only, so dimensions grow, lookups in run 1's dimensions miss, and keys are orphans
there.  Some names are longer than the mart's text columns, so the typed copy truncates.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestar import schemas as S
from lakestar.functions.dates import RunContext

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# Fixed values of the derived feed: the two runs and their landing file names.
RUN_1 = RunContext("run-1", datetime(2024, 5, 21, 10, 0, 0))
RUN_2 = RunContext("run-2", datetime(2024, 5, 22, 10, 0, 0))
FILE_1 = "feed-1.csv"
FILE_2 = "feed-2.csv"
RUNS = (RUN_1, RUN_2)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _null_if(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None)).otherwise(value)


def in_run_2() -> Column:
    """Rows of the second run: a third of the orders, and the members only it brings.

    No part is ever NULL: a reader of the first run alone drops each part's rows before the joins.
    """
    parts = (F.col("l_orderkey") % 3 == 0, F.length("p_name") % 5 == 0,
             F.col("n_nationkey") == 7, F.year("o_orderdate") == 1996)
    return reduce(or_, (F.coalesce(part, F.lit(False)) for part in parts))


def long_name() -> Column:
    """The part name, for some parts repeated beyond the mart's text length."""
    return F.when(F.col("is_long"), F.repeat("p_name", 40)).otherwise(F.col("p_name"))


def names_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze-shaped rows of both runs (landing columns + audit/lineage columns)."""
    q = F.col("l_quantity")
    ln = F.col("l_linenumber")
    count = (
        F.when((ln == 7) & (q > 40), F.lit(0))
        .when((ln == 6) & (q > 45), F.lit(-1))
        .when((ln == 5) & (q > 45), F.lit(None))
        .otherwise(q.cast("int"))
    )
    # The values that a line makes by itself go through the shuffles, not what they are made of.
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_shipdate", count.cast("int").alias(S.MEASURE_RAW),
        _null_if((F.col("l_suppkey") % 83 == 0) & (ln == 1), F.col("l_returnflag")).alias("sex"),
    )
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    order_side = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "o_orderdate", "n_nationkey", "n_name")
    )
    line_side = li.join(part, li.l_partkey == part.p_partkey).select(
        "l_orderkey", "l_shipdate", S.MEASURE_RAW, "sex", "p_name",
        (F.col("l_partkey") % 61 == 0).alias("is_long"),
        (F.col("l_partkey") % 89 == 0).alias("no_county"),
    )
    rows = line_side.join(order_side, line_side.l_orderkey == order_side.o_orderkey)

    run2 = in_run_2()
    return rows.select(
        _null_if(F.col("l_orderkey") % 101 == 0, F.year("o_orderdate").cast("int")).alias("year"),
        _null_if(F.col("l_orderkey") % 97 == 0, long_name()).alias("first_name"),
        _null_if(F.col("no_county"), F.col("n_name")).alias("county"),
        "sex",
        S.MEASURE_RAW,
        F.when(run2, RUN_2.processing_literal()).otherwise(RUN_1.processing_literal())
        .alias(S.PROCESSING_DATE),
        F.when(run2, F.lit(RUN_2.run_id)).otherwise(F.lit(RUN_1.run_id)).alias(S.RUN_ID),
        F.when(run2, F.lit(FILE_2)).otherwise(F.lit(FILE_1)).alias(S.INPUT_FILENAME),
        F.col("l_shipdate").cast("timestamp_ntz").alias(S.INPUT_MODIFIED),
    )


def run_rows(feed: DataFrame, ctx: RunContext) -> DataFrame:
    """The rows one run lands (by its run id)."""
    return feed.filter(F.col(S.RUN_ID) == ctx.run_id)


def landing_rows(feed: DataFrame) -> DataFrame:
    """The landing-file columns only."""
    return feed.select(*S.LANDING_COLUMNS)


__all__ = [
    "FILE_1",
    "FILE_2",
    "RUNS",
    "RUN_1",
    "RUN_2",
    "TABLES",
    "landing_rows",
    "names_feed",
    "read_table",
    "run_rows",
]
