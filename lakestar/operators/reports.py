"""Analyst reports over the mart (and one straight from silver).

A report filters its dimensions, joins them to the fact, and sums.  The filtered year comes
first: on a fact partitioned by year it prunes directories (dynamic partition pruning).
Ties in a top-k are broken by name, so the k rows are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _equals(column: str, value: str, case_insensitive: bool) -> Column:
    col = F.collate(F.col(column), "UTF8_LCASE") if case_insensitive else F.col(column)
    return col == F.lit(value)


def _totals(fact: DataFrame, years: DataFrame, names: DataFrame, by: str) -> DataFrame:
    """Total count per ``by`` of the fact rows whose year and name are among those given."""
    years = years.select(F.col("sid").alias("yearSid"), "year")
    names = names.select(F.col("sid").alias("nameSid"), "first_name")
    return (fact.select("yearSid", "nameSid", "count").join(years, "yearSid")
            .join(names, "nameSid").groupBy(by).agg(F.sum("count").alias("total_count")))


def _top(totals: DataFrame, value: str, key: str, k: int) -> DataFrame:
    return totals.orderBy(F.desc(value), F.asc(key)).limit(int(k))


def top_names(spark: SparkSession, fact: DataFrame, names: DataFrame, years: DataFrame,
              sex: str, year: int, k: int = 10, case_insensitive: bool = False) -> DataFrame:
    """Top ``k`` names of one sex in one year by total count."""
    chosen = names.where(_equals("sex", sex, case_insensitive))
    totals = _totals(fact, years.where(F.col("year") == int(year)), chosen, "first_name")
    return _top(totals, "total_count", "first_name", k)


def name_by_year(spark: SparkSession, fact: DataFrame, names: DataFrame, years: DataFrame,
                 name: str, case_insensitive: bool = False) -> DataFrame:
    """Total count of one name per year, largest first."""
    chosen = names.where(_equals("first_name", name, case_insensitive))
    return _totals(fact, years, chosen, "year").orderBy(F.desc("total_count"), F.asc("year"))


def top_names_silver(spark: SparkSession, silver: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` names overall, straight from silver (no join)."""
    totals = silver.groupBy("first_name").agg(F.sum("count").alias("cnt"))
    return _top(totals, "cnt", "first_name", k)
