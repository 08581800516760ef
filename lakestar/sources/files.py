"""File-level edges: landing CSV in and out, file lineage, modified-since scans."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestar import schemas as S
from lakestar.functions.dates import RunContext

# Landing file format (comma, double quote, backslash escape, header row).
CSV_OPTIONS = {"header": "true", "sep": ",", "quote": '"', "escape": "\\"}
#: Where a scan keeps a line with a value that does not parse, and the raw texts of such values.
_CORRUPT, RESCUED = "__corrupt_line", "_rescued"


def read_landing(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = S.LANDING_SCHEMA,
    infer: bool = False,
    rfc4180: bool = False,
) -> DataFrame:
    """Scan a landing CSV (header row).

    A declared schema is the default: inference reads the data twice and can change type
    from one file to the next.  ``rfc4180`` reads doubled quotes (``""``) as a quote.
    """
    reader = spark.read.options(**CSV_OPTIONS)
    if rfc4180:
        reader = reader.option("escape", '"')
    if infer or schema is None:
        reader = reader.option("inferSchema", "true")
    else:
        reader = reader.schema(schema).option("enforceSchema", "false")
    return reader.csv(path)


def read_landing_rescued(spark: SparkSession, path: str,
                         schema: T.StructType = S.LANDING_SCHEMA) -> DataFrame:
    """Scan a landing CSV and keep the raw text of values that do not parse.

    The declared columns, null where a value does not parse, and ``_rescued``: a map from column
    name to the raw text of such values (null on rows without any).
    """
    if _CORRUPT in schema.fieldNames() or RESCUED in schema.fieldNames():
        raise ValueError(f"a landing schema cannot hold {_CORRUPT} or {RESCUED}")
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    rows = (spark.read.options(**CSV_OPTIONS).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", _CORRUPT).option("enforceSchema", "false")
            .schema(T.StructType([*schema, T.StructField(_CORRUPT, T.StringType())])).csv(path))
    raw = F.from_csv(F.col(_CORRUPT), texts.toDDL(),
                     {k: v for k, v in CSV_OPTIONS.items() if k != "header"})
    pairs = [F.struct(F.lit(f.name).alias("key"), F.col("__raw")[f.name].alias("value"))
             for f in schema]
    lost = F.filter(F.array(*[
        F.when(F.col(f"`{f.name}`").isNull() & F.col("__raw")[f.name].isNotNull(), pair)
        for f, pair in zip(schema, pairs, strict=True)]), lambda x: x.isNotNull())
    return rows.withColumn("__raw", raw).withColumn(
        RESCUED, F.when(F.col(_CORRUPT).isNotNull(), F.map_from_entries(lost))).select(
        *(F.col(f"`{c}`") for c in schema.fieldNames()), RESCUED)


def reconciled(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df``, of whatever inferred types, as the declared columns in the declared order.

    A missing column is null, an extra one is left out (:func:`schema_differences` lists both),
    and a value that does not fit the declared type is null.
    """
    return df.select(*[
        (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns
         else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def schema_differences(found: T.StructType, declared: T.StructType) -> list[tuple[str, str]]:
    """(column, ``missing`` | ``extra`` | ``<found type> for <declared type>``) where they differ."""
    types = {f.name: f.dataType.simpleString() for f in found}
    wanted = {f.name: f.dataType.simpleString() for f in declared}
    return ([(c, "missing") for c in wanted if c not in types]
            + [(c, "extra") for c in types if c not in wanted]
            + [(c, f"{types[c]} for {t}") for c, t in wanted.items()
               if c in types and types[c] != t])


def require_columns(df: DataFrame, columns: tuple[str, ...] = S.LANDING_COLUMNS) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"landing file lacks columns {missing}; found {df.columns}")
    return df


def with_file_lineage(df: DataFrame) -> DataFrame:
    """Source file path and modification time of every row (hidden ``_metadata`` column).

    The modification time is stored as ``timestamp_ntz`` in the session time zone (UTC in
    pipeline sessions).
    """
    return df.withColumns(
        {
            S.INPUT_FILENAME: F.col("_metadata.file_path"),
            S.INPUT_MODIFIED: F.col("_metadata.file_modification_time").cast("timestamp_ntz"),
        }
    )


def with_audit(df: DataFrame, ctx: RunContext) -> DataFrame:
    """Processing time and run id of the run, as literals computed once per run."""
    return df.withColumns({S.PROCESSING_DATE: ctx.processing_literal(), S.RUN_ID: F.lit(ctx.run_id)})


def write_landing(df: DataFrame, path: str, rfc4180: bool = False) -> None:
    """Delimited-text rewrite: header, every field quoted.

    Overwrites ``path``: re-running the same run rewrites the same file set.
    """
    writer = df.write.mode("overwrite").options(**CSV_OPTIONS).option("quoteAll", "true")
    if rfc4180:
        writer = writer.option("escape", '"')
    writer.csv(path)


def read_modified_since(
    spark: SparkSession,
    root: str,
    since: datetime,
    glob: str = "*.parquet",
    schema: T.StructType | None = None,
) -> DataFrame:
    """Parquet files under ``root`` (recursive) modified after ``since`` (UTC).

    Partition discovery is off, as with a recursive file listing.  This is a raw file
    scan: it sees every file written in the window, including superseded ones, so the
    result needs a one-row-per-key step before it is loaded anywhere.  Give ``schema``:
    an empty window has no file to infer one from.
    """
    reader = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("modifiedAfter", since.strftime("%Y-%m-%dT%H:%M:%S"))
        .option("timeZone", "UTC")
    )
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(root)
