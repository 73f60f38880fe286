"""Calendar features of a time column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def calendar_features(time: str | Column) -> list[Column]:
    """month, day, weekday (Monday = 0), hour and quarter-hour number."""
    t = F.col(time) if isinstance(time, str) else time
    return [
        F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.weekday(t).alias("weekday"),
        F.hour(t).alias("hour"), F.floor(F.minute(t) / 15).cast("int").alias("quarter"),
    ]


def time_micros(df: DataFrame, column: str) -> Column:
    """A time column as whole microseconds since the epoch: timestamps, or integers that count nanoseconds.

    Anything else is an error, floats included: read as a count they would shift every time without a trace.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(column).cast("timestamp"))
    if isinstance(kind, (T.LongType, T.IntegerType)):
        whole = f"cast(`{column}` AS bigint)"
        return F.expr(f"({whole} - pmod({whole}, 1000L)) div 1000L")
    raise TypeError(f"{column} must be a timestamp or integer nanoseconds since the epoch; got {kind.simpleString()}")
