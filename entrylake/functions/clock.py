"""Event times as whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

SECOND = 1_000_000


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, or of a column of epoch seconds.

    Timestamps without zone are read as UTC, the time zone of the product; the session
    time zone must be UTC too.
    """
    column = F.col(name)
    if isinstance(df.schema[name].dataType, IntegralType):
        return column.cast("long") * SECOND
    return F.unix_micros(column.cast("timestamp"))


def from_micros(df: DataFrame, name: str, value: Column) -> Column:
    """The inverse of ``micros``, in the type of ``df[name]``."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, IntegralType):
        return F.floor(value / SECOND).cast(dtype)
    return F.timestamp_micros(value).cast(dtype)
