"""Surrogate keys: dense, ordered identity values without a single-partition window.

``assign_sid`` numbers rows ``start, start + 1, ...`` in a total order:

1. ``repartitionByRange(n, order)`` + ``sortWithinPartitions(order)``: partition ``i`` holds
   a contiguous, sorted slice of the order;
2. ``checkpoint()`` in the shared folder: the per-partition counts and the numbering read
   exactly the same split, and a lost executor cannot change it;
3. per-partition row counts (``n`` numbers) give each partition its offset;
4. a row's id = start + offset(partition) + position inside the partition
   (``monotonically_increasing_id`` carries the position in its low 33 bits).

The work is spread over ``n`` tasks; only the ``n`` partition counts reach the driver.
The result equals ``row_number() over (order by ...) - 1 + start``.

The same steps run at every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestar import schemas as S
from lakestar.session import cut_lineage

_PID, _MID = "__pid", "__mid"


def next_sid(target: DataFrame | None, sid_col: str = S.SID, start: int = S.SID_START) -> int:
    """First free identity value of ``target`` (``start`` when empty or missing)."""
    if target is None:
        return start
    row = target.agg(F.max(sid_col).alias("m")).first()
    return start if row is None or row["m"] is None else max(int(row["m"]) + 1, start)


def assign_sid(
    df: DataFrame,
    order: Sequence[str | Column],
    start: int = S.SID_START,
    sid_col: str = S.SID,
    num_partitions: int | None = None,
) -> DataFrame:
    """``df`` with ``sid_col`` first: ``start + rank - 1`` in ``order`` (must be total)."""
    spark = df.sparkSession
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = cut_lineage(df.repartitionByRange(n, *cols).sortWithinPartitions(*cols))
    tagged = ranged.select(
        F.spark_partition_id().alias(_PID), F.monotonically_increasing_id().alias(_MID), *df.columns
    )
    counts = sorted(
        (r[_PID], r["n"]) for r in tagged.groupBy(_PID).agg(F.count(F.lit(1)).alias("n")).collect()
    )
    offsets, running = [], start
    for pid, cnt in counts:
        offsets.append((pid, running))
        running += cnt
    off_schema = T.StructType(
        [T.StructField(_PID, T.IntegerType()), T.StructField("__off", T.LongType())]
    )
    # One row per partition: a proven, small bound.
    off = F.broadcast(spark.createDataFrame(offsets, off_schema))
    position = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    return tagged.join(off, _PID).select(
        (F.col("__off") + position).cast("long").alias(sid_col), *df.columns
    )
