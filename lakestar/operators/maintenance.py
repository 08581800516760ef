"""Small-file compaction, and when a table is due for it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Operation of a compaction in the history of tables.
COMPACT = "COMPACT"
#: What a compaction's metrics name the files that it left of a day (the day follows).
FILES_OF_DAY = "numFilesOfDay "
#: Fixed value: a table is left alone while one of its last 30 operations was a compaction.
RECENT_OPERATIONS = 30


def compacted(df: DataFrame, num_files: int, cluster_by: Sequence[str]) -> DataFrame:
    """``df`` laid out as ``num_files`` range-clustered, sorted partitions.

    Range clustering keeps rows with near keys in the same file, so later key filters skip
    whole files through Parquet min/max statistics.  A per-row id is the last range key:
    a key (or a group of identical rows) holding a large share of the data is split over
    several files instead of one oversized task.  Rows are unchanged.
    """
    rid = "__row_id"
    keyed = df.withColumn(rid, F.monotonically_increasing_id())
    return (
        keyed.repartitionByRange(int(num_files), *cluster_by, rid)
        .sortWithinPartitions(*cluster_by, rid)
        .drop(rid)
    )


def target_files(total_bytes: int, file_bytes: int = 256 << 20) -> int:
    """Number of files for ``total_bytes`` of data at about ``file_bytes`` each."""
    return max(1, -(-int(total_bytes) // int(file_bytes)))


def input_bytes(df: DataFrame) -> int:
    """Total size of the files a file-based frame reads (from the hidden ``_metadata``)."""
    return input_bytes_of(df.select("_metadata.file_path", "_metadata.file_size"))


def input_bytes_of(files: DataFrame) -> int:
    """Total of ``(file_path, file_size)`` rows, each file counted once."""
    row = files.toDF("p", "b").distinct().agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return int(row["b"])


def row_bytes(df: DataFrame) -> int:
    """Bytes of the rows as a task holds them; their files, encoded and compressed, are smaller."""
    held = F.lit(8 + 8 * len(df.columns)).cast("long")
    for f in df.schema:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            held += F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
    return int(df.select(F.coalesce(F.sum(held), F.lit(0)).alias("b")).first()["b"])


def files_needed(df: DataFrame, file_bytes: int = 256 << 20, stored: int | None = None) -> int:
    """Number of files for the rows of a file-based frame, at most about ``file_bytes`` of rows each.

    A file is sorted and written by one task, so the rows it holds count, not the bytes it ends up
    with: a well compressed day would else come to one task whole.  ``stored``: the total size of
    the frame's files, if a listing has given it (else the frame is scanned for it).
    """
    return target_files(max(input_bytes(df) if stored is None else stored, row_bytes(df)), file_bytes)


def files_left(history: DataFrame, table: str) -> DataFrame:
    """Per day of a table: the files that its last compaction left (day, left)."""
    found = (history.where((F.col("operation") == COMPACT) & (F.col("table") == table))
             .select("version", F.explode("metrics").alias("name", "value"))
             .where(F.startswith("name", F.lit(FILES_OF_DAY))))
    day = F.substring("name", len(FILES_OF_DAY) + 1, 10).cast("date")
    return found.groupBy(day.alias("day")).agg(
        F.max_by(F.col("value").cast("long"), "version").alias("left"))


def compaction_due(history: DataFrame, recent: int = RECENT_OPERATIONS) -> DataFrame:
    """Per table of a history: what happened since its last compaction, and whether one is due.

    ``operations`` and ``rows_since`` (read from the map of metrics) count what was written after
    the version that was last compacted (null: never); a compaction is the last operation of its
    version.  ``due``: none of the last ``recent`` operations was a compaction.
    """
    compacts = F.col("operation") == COMPACT
    last = F.max(F.when(compacts, F.col("version"))).over(Window.partitionBy("table"))
    later = ~compacts & (F.col("version") > F.coalesce(F.col("compacted_version"), F.lit(-1)))
    rows = F.col("metrics")["numOutputRows"].cast("long")
    return (history.withColumn("compacted_version", last)
            .groupBy("table", "compacted_version")
            .agg(F.count_if(later).alias("operations"),
                 F.coalesce(F.sum(F.when(later, rows)), F.lit(0)).alias("rows_since"))
            .withColumn("due", F.col("compacted_version").isNull()
                        | (F.col("operations") >= int(recent))))


def fragmented(files: DataFrame, least_files: int, file_bytes: int = 256 << 20,
               left: DataFrame | None = None) -> DataFrame:
    """Of ``(day, length)`` rows, one per file: the days with many more files than they need.

    A day needs a file per ``file_bytes`` stored, or as many as its last compaction ``left``.
    """
    days = files.groupBy("day").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    need = F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(int(file_bytes))))
    if left is not None:
        days = days.join(left, "day", "left")
        need = F.greatest(need, F.col("left"))
    return (days.where((F.col("files") >= int(least_files)) & (F.col("files") > 2 * need))
            .select("day", "files", "bytes"))
