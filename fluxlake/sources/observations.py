"""Observation tables: column-pruned scans and the clean-up every source needs.

An observation table is long: one row per (time, series) with one or more value columns.
Missing values are NULL from here on; NaN never leaves a source.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, path: str, columns: list[str] | None = None,
         schema: T.StructType | None = None) -> DataFrame:
    """Read Parquet (pruned to ``columns``) or CSV (all columns, schema given or inferred)."""
    if str(path).endswith(".csv"):
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        return reader.csv(path)
    df = spark.read.parquet(path)
    if columns is None:
        return df
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"columns {absent} not found in {path}")
    return df.select(*columns)


def clean_types(df: DataFrame) -> DataFrame:
    """NaN to NULL in floating columns; zone-less timestamps to (UTC) timestamps."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            col = F.nanvl(col, F.lit(None).cast(field.dataType))
        elif isinstance(field.dataType, T.TimestampNTZType):
            col = col.cast("timestamp")
        out.append(col.alias(field.name))
    return df.select(*out)


def observations(df: DataFrame, time: str, value: str | Column, series: str | Column,
                 extra: dict[str, Column] | None = None) -> DataFrame:
    """Project any table to ``(time_utc, series, value, …)``; rows without a time are dropped."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    cols = [
        F.col(time).cast("timestamp").alias("time_utc"),
        as_col(series).alias("series"),
        as_col(value).cast("double").alias("value"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    ]
    return clean_types(df.select(*cols)).filter(F.col("time_utc").isNotNull())


def filter_role(df: DataFrame, role: str | None = "primary", role_col: str = "role") -> DataFrame:
    """Keep one role; no filter when ``role`` is None or the table has no role column."""
    if role is None or role_col not in df.columns:
        return df
    return df.filter(F.col(role_col) == F.lit(role))


def filter_years(df: DataFrame, years: list[int] | None, time: str = "time_utc") -> DataFrame:
    """Restrict to whole years with plain range predicates, which reach the Parquet scan."""
    if not years:
        return df
    wanted = F.lit(False)
    for year in sorted(set(years)):
        wanted = wanted | ((F.col(time) >= F.lit(f"{year}-01-01").cast("timestamp"))
                           & (F.col(time) < F.lit(f"{year + 1}-01-01").cast("timestamp")))
    return df.filter(wanted)


class ChannelSpec(NamedTuple):
    """A channel on the command line: the table's path and, after the last colon, its column."""

    path: str
    column: str

    @classmethod
    def parse(cls, text: str) -> ChannelSpec:
        parts = re.fullmatch(r"(?P<path>.+):(?P<column>[^:]+)", text)
        if parts is None:
            raise ValueError(f"{text!r} names no table and column, as in samples.parquet:flux")
        return cls(**parts.groupdict())


def targets_among(channels: list[str], wanted: list[str] | None = None) -> list[str]:
    """The wanted channels, or the first one; they must exist."""
    if not wanted:
        return channels[:1]
    if missing := sorted(set(wanted).difference(channels)):
        raise ValueError(f"no such channel: {', '.join(missing)}")
    return [*wanted]


def csv_feature_columns(df: DataFrame, target: str, time: str | None = None) -> list[str]:
    """Feature columns of a generic CSV: everything but the target and the time column."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    return [c for c in df.columns if c not in (target, time)]


def write_sorted(df: DataFrame, path: str, time: str = "time_utc",
                 sort: tuple[str, ...] = ("time_utc", "series")) -> None:
    """Snappy Parquet by year, range-partitioned on time and sorted inside each file."""
    (df.withColumn("year", F.year(time))
       .repartitionByRange(*sort)
       .sortWithinPartitions("year", *sort)
       .write.mode("overwrite").option("compression", "snappy").partitionBy("year").parquet(path))
