from __future__ import annotations

from datetime import datetime

from lakestar import schemas as S
from lakestar.plans.medallion import SILVER_SCHEMA

SF0001 = "/root/testdata/sf0.001"

T1 = datetime(2024, 1, 1, 0, 0, 0)
T2 = datetime(2024, 1, 2, 0, 0, 0)
P1 = datetime(2024, 5, 21, 10, 0, 0)
P2 = datetime(2024, 5, 22, 10, 0, 0)


def silver_rows(spark, rows):
    """Rows as (year, first_name, county, sex, count, processing, run, file, modified)."""
    return spark.createDataFrame(rows, SILVER_SCHEMA)


def bronze_rows(spark, rows):
    return spark.createDataFrame(rows, S.BRONZE_SCHEMA)


def row(year=2019, name="ABEL", county="KINGS", sex="M", count=5, pd=P1, run="run-1",
        file="f.csv", mod=T1):
    return (year, name, county, sex, count, pd, run, file, mod)


def as_set(df, cols=None):
    cols = cols or df.columns
    return {tuple(r[c] for c in cols) for r in df.collect()}


def as_list(df, order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
