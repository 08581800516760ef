"""Schemas, key lists and rule lists of the pipeline.

Fixed values: the names, types and lengths below must equal the data model the pipeline
reproduces (landing file, bronze/silver/gold tables, reporting mart), so they are stated
here once, in natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Landing file and layer columns.
# ---------------------------------------------------------------------------
LANDING_SCHEMA = T.StructType(
    [
        T.StructField("year", T.IntegerType()),
        T.StructField("first_name", T.StringType()),
        T.StructField("county", T.StringType()),
        T.StructField("sex", T.StringType()),
        T.StructField("name_count", T.IntegerType()),
    ]
)
LANDING_COLUMNS = tuple(f.name for f in LANDING_SCHEMA.fields)

# Audit / lineage columns added in bronze, in the order they are added.
PROCESSING_DATE = "_processing_date"
RUN_ID = "_pipeline_run_id"
INPUT_FILENAME = "_input_filename"
INPUT_MODIFIED = "_input_file_modification_date"
AUDIT_COLUMNS = (PROCESSING_DATE, RUN_ID, INPUT_FILENAME, INPUT_MODIFIED)

BRONZE_SCHEMA = T.StructType(
    LANDING_SCHEMA.fields
    + [
        T.StructField(PROCESSING_DATE, T.TimestampNTZType()),
        T.StructField(RUN_ID, T.StringType()),
        T.StructField(INPUT_FILENAME, T.StringType()),
        T.StructField(INPUT_MODIFIED, T.TimestampNTZType()),
    ]
)
BRONZE_COLUMNS = tuple(f.name for f in BRONZE_SCHEMA.fields)

# Partition column of bronze and the errors table (derived, dropped on read).
PROCESSING_DAY = "_processing_day"
#: What one append wrote: a second attempt at it replaces its own rows only.
BATCH = "_batch"

# Catalog names of the layer tables (database, table).
BRONZE_TABLE = ("bronze", "new_york_baby_names")
SILVER_TABLE = ("silver", "new_york_baby_names")
ERRORS_TABLE = ("silver", "new_york_baby_names_errors")
GOLD_TABLE_NAMES = {
    "dim_names": ("gold", "reference_dim_names"),
    "dim_years": ("gold", "reference_dim_years"),
    "dim_locations": ("gold", "reference_dim_locations"),
    "fact": ("gold", "fact_baby_names"),
}

MART_TABLE_NAMES = {
    "dim_names": ("mart", "dim_names"),
    "dim_years": ("mart", "dim_years"),
    "dim_locations": ("mart", "dim_locations"),
    "fact": ("mart", "fact_babynames"),
}

# Silver renames the measure.
MEASURE_RAW = "name_count"
MEASURE = "count"
SILVER_COLUMNS = tuple(MEASURE if c == MEASURE_RAW else c for c in BRONZE_COLUMNS)

# Natural key of a silver row.
NATURAL_KEY = ("year", "first_name", "county", "sex")

# Quality rule: these columns must be present and the measure positive.
REQUIRED_COLUMNS = ("year", "first_name", "county", "sex", "count")
POSITIVE_COLUMNS = ("count",)

# Gold control columns.
KEY_HASH = "_keyHash"
VALUE_HASH = "_valueHash"
CONTROL_COLUMNS = (KEY_HASH, VALUE_HASH, RUN_ID, PROCESSING_DATE)

# Surrogate keys: identity starts at 0, step 1; -1 is the unknown member.
SID = "sid"
SID_START = 0
UNKNOWN_SID = -1

# Parameter formats of the run (day for silver/gold, timestamp for bronze).
DAY_FORMAT = "dd-MM-yyyy"
TIMESTAMP_FORMAT = "dd-MM-yyyy HH:mm:ss"
LANDING_FILE_PREFIX = "nybabynames-"
LANDING_FILE_SUFFIX = ".csv"

# ---------------------------------------------------------------------------
# Gold tables (sid + business columns + control columns).
# ---------------------------------------------------------------------------
DIM_NAMES_SCHEMA = T.StructType(
    [
        T.StructField("sid", T.LongType()),
        T.StructField("first_name", T.StringType()),
        T.StructField("sex", T.StringType()),
        T.StructField("_keyHash", T.StringType()),
        T.StructField("_valueHash", T.StringType()),
        T.StructField("_pipeline_run_id", T.StringType()),
        T.StructField("_processing_date", T.TimestampNTZType()),
    ]
)
DIM_YEARS_SCHEMA = T.StructType(
    [
        T.StructField("sid", T.LongType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("_keyHash", T.StringType()),
        T.StructField("_valueHash", T.StringType()),
        T.StructField("_pipeline_run_id", T.StringType()),
        T.StructField("_processing_date", T.TimestampNTZType()),
    ]
)
DIM_LOCATIONS_SCHEMA = T.StructType(
    [
        T.StructField("sid", T.LongType()),
        T.StructField("county", T.StringType()),
        T.StructField("_keyHash", T.StringType()),
        T.StructField("_valueHash", T.StringType()),
        T.StructField("_pipeline_run_id", T.StringType()),
        T.StructField("_processing_date", T.TimestampNTZType()),
    ]
)
# locationSid is a bigint here (the declared string type of the original is a defect).
FACT_SCHEMA = T.StructType(
    [
        T.StructField("sid", T.LongType()),
        T.StructField("nameSid", T.LongType()),
        T.StructField("yearSid", T.LongType()),
        T.StructField("locationSid", T.LongType()),
        T.StructField("count", T.IntegerType()),
        T.StructField("_keyHash", T.StringType()),
        T.StructField("_valueHash", T.StringType()),
        T.StructField("_pipeline_run_id", T.StringType()),
        T.StructField("_processing_date", T.TimestampNTZType()),
    ]
)

# ---------------------------------------------------------------------------
# Reporting mart column mappings (source column, sink column, sink type,
# max length for strings).  Lengths: names and counties nvarchar(265), sex nvarchar(10).
# ---------------------------------------------------------------------------
MART_DIM_NAMES = (
    ("sid", "sid", "bigint", None),
    ("first_name", "first_name", "string", 265),
    ("sex", "sex", "string", 10),
)
MART_DIM_YEARS = (
    ("sid", "sid", "bigint", None),
    ("year", "year", "int", None),
)
MART_DIM_LOCATIONS = (
    ("sid", "sid", "bigint", None),
    ("county", "county", "string", 265),
)
MART_FACT = (
    ("sid", "sid", "bigint", None),
    ("nameSid", "nameSid", "bigint", None),
    ("yearSid", "yearSid", "bigint", None),
    ("locationSid", "locationSid", "bigint", None),
    ("count", "count", "int", None),
)

# Foreign keys of the mart fact: (fact column, dimension table).
MART_FOREIGN_KEYS = (
    ("nameSid", "dim_names"),
    ("yearSid", "dim_years"),
    ("locationSid", "dim_locations"),
)
