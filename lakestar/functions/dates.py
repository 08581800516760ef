"""Run parameters and day predicates.

Run parameters come as text (``dd-MM-yyyy`` for a day, ``dd-MM-yyyy HH:mm:ss`` for the
processing time).  They are parsed once per run into :class:`RunContext`, so every step of a
run sees the same instant (a run that crosses midnight does not change its day half-way).
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakestar import schemas as S

_PY_DAY = "%d-%m-%Y"
_PY_TS = "%d-%m-%Y %H:%M:%S"


def parse_day(text: str) -> date:
    """``'22-05-2024'`` -> ``date(2024, 5, 22)``."""
    return datetime.strptime(text, _PY_DAY).date()


def parse_timestamp(text: str) -> datetime:
    """``'21-05-2024 18:39:52'`` -> naive ``datetime``."""
    return datetime.strptime(text, _PY_TS)


def ts_literal(value: datetime) -> Column:
    """A ``timestamp_ntz`` literal (zone-independent)."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def day_literal(value: date) -> Column:
    return F.lit(value.isoformat()).cast("date")


def day_predicate(column: str, day: date) -> Column:
    """Rows whose timestamp falls on ``day``: the half-open range ``[day, day + 1)``.

    Written as a range on the raw column (not ``to_date(col) = day``) so the comparison
    is pushed to the Parquet reader as two bounds.
    """
    start = datetime.combine(day, datetime.min.time())
    end = start + timedelta(days=1)
    c = F.col(column)
    return (c >= ts_literal(start)) & (c < ts_literal(end))


def format_day(c: str | Column) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, S.DAY_FORMAT)


def format_timestamp(c: str | Column) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, S.TIMESTAMP_FORMAT)


def parse_day_col(c: str | Column) -> Column:
    """Day text -> ``timestamp_ntz`` at midnight."""
    return F.to_timestamp_ntz(F.col(c) if isinstance(c, str) else c, F.lit(S.DAY_FORMAT))


def parse_timestamp_col(c: str | Column) -> Column:
    return F.to_timestamp_ntz(F.col(c) if isinstance(c, str) else c, F.lit(S.TIMESTAMP_FORMAT))


@dataclass(frozen=True)
class RunContext:
    """Everything a run derives from the clock, computed once."""

    run_id: str
    processing_ts: datetime

    @classmethod
    def from_params(cls, run_id: str, processing_date: str) -> RunContext:
        """Accepts either parameter format (timestamp or day)."""
        try:
            ts = parse_timestamp(processing_date)
        except ValueError:
            ts = datetime.combine(parse_day(processing_date), datetime.min.time())
        return cls(run_id, ts)

    @property
    def day(self) -> date:
        return self.processing_ts.date()

    @property
    def day_param(self) -> str:
        return self.processing_ts.strftime(_PY_DAY)

    @property
    def timestamp_param(self) -> str:
        return self.processing_ts.strftime(_PY_TS)

    @property
    def landing_filename(self) -> str:
        return f"{S.LANDING_FILE_PREFIX}{self.day_param}{S.LANDING_FILE_SUFFIX}"

    @property
    def modified_since(self) -> datetime:
        """Cut-off of the mart copy: one day before the run."""
        return self.processing_ts - timedelta(days=1)

    def processing_literal(self) -> Column:
        return ts_literal(self.processing_ts)
