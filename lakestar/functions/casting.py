"""Column-mapped typed copy (source column -> sink column with a type and a max length)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Mapping = Iterable[tuple[str, str, str, int | None]]

_NUMERIC_SINKS = {"bigint", "int", "smallint", "tinyint", "double", "float"}


def convert(
    c: str | Column,
    sink_type: str,
    max_length: int | None = None,
    source_type: T.DataType | None = None,
) -> Column:
    """Convert one value to the sink type.

    ``try_cast``: a value that does not convert becomes NULL instead of failing the job
    (ANSI ``cast`` would abort on ``'abc'`` -> bigint).  Strings longer than the sink length
    are cut, since ``cast(... as varchar(n))`` does not shorten a value.  Booleans are not
    numbers: a boolean column sent to a numeric sink becomes NULL.
    """
    col = F.col(c) if isinstance(c, str) else c
    if sink_type == "string":
        text = col.cast("string")
        return F.left(text, F.lit(max_length)) if max_length else text
    if sink_type in _NUMERIC_SINKS and isinstance(source_type, T.BooleanType):
        return F.lit(None).cast(sink_type)
    return col.try_cast(sink_type)


def copy_mapped(df: DataFrame, mapping: Mapping) -> DataFrame:
    """Project ``df`` through a column mapping ``(source, sink, sink_type, max_length)``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            convert(src, sink_type, max_len, types.get(src)).alias(sink)
            for src, sink, sink_type, max_len in mapping
        ]
    )
