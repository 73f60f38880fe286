"""Order-dependent steps that never put a whole series into one task.

A series may hold a large share of all rows, so a window over ``partitionBy(series)`` is only
used on tables whose size per series is bounded by the time grid. Raw samples are cut into slices
of their full order, tie-breaks included, so neither a hot series nor a hot instant stays in one
slice: rows are ordered inside ``(series, slice)``, one summary row per slice is carried to the
following slice, and the two are joined on ``(series, slice)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxlake.session import materialize

SLICE_ROWS = 1_000_000
MINUTE_US, DAY_US = 60_000_000, 86_400_000_000


def time_slice(time: str, width_us: int) -> Column:
    return F.floor(F.unix_micros(F.col(time)) / F.lit(width_us)).cast("long")


def slice_width(df: DataFrame, keys: list[str], time: str, rows: int = SLICE_ROWS) -> int:
    """Slice width in microseconds so that no (key, slice) holds many more than ``rows`` rows.

    The densest minute of any key decides, so a hot key or a burst narrows the slices (down to a
    microsecond) and sparse data keeps one slice per day. The counting pass reads the keys and the
    time only and combines on the map side.
    """
    per_minute = df.groupBy(*keys, time_slice(time, MINUTE_US).alias("_m")).agg(F.count("*").alias("_n"))
    densest = per_minute.agg(F.max("_n")).first()[0] or 1
    return max(1, min(DAY_US, MINUTE_US * rows // densest))


def in_ranges(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_slice``, non-decreasing in ``order``: ranges of about equal size, as many as given or
    as the session has shuffle partitions. For one use, since the numbers may change between uses."""
    cut = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return cut.withColumn("_slice", F.spark_partition_id())


def range_slices(df: DataFrame, order: list[str]) -> DataFrame:
    """:func:`in_ranges`, written once, so that the numbers are the same in all uses."""
    return materialize(in_ranges(df, order), "ordered")


def keep_one(df: DataFrame, keys: list[str], order: list[str], keep: str = "last") -> DataFrame:
    """One row per key: the last (or first) in ``order``. ``order`` must be unique per key.

    ``max_by`` combines on the map side, so many copies of one key collapse before the shuffle.
    """
    others = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    picked = df.groupBy(*keys).agg(
        pick(F.struct(*others), F.struct(*[F.col(c) for c in order])).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], prefix: str = "") -> Column:
    """Null-safe equality of the keys, which ``right`` has under a prefix."""
    return reduce(Column.__and__, [left[k].eqNullSafe(right[prefix + k]) for k in keys], F.lit(True))


def _with_slices(df: DataFrame, keys: list[str], order: list[str], slice_expr: Column | None) -> DataFrame:
    return range_slices(df, [*keys, *order]) if slice_expr is None else df.withColumn("_slice", slice_expr)


def _joined_on_slice(sliced: DataFrame, borders: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``sliced`` with the columns of its slice's row; a missing key or slice meets a missing one."""
    on = [*keys, "_slice"]
    side = borders.select(*[F.col(c).alias(f"_on_{c}") for c in on], *columns)
    return sliced.join(side, same_keys(sliced, side, on, "_on_")).drop(*[f"_on_{c}" for c in on])


def beside(df: DataFrame, keys: list[str], order: list[str], columns: list[str],
           slice_expr: Column | None = None) -> DataFrame:
    """Add ``_before`` and ``_after``: structs of ``columns`` of the neighbouring rows of the same key.

    ``slice_expr``, if given, must be non-decreasing in ``order``; else the slices are ranges. A slice's border rows
    come from one row per slice.
    """
    sliced = _with_slices(df, keys, order, slice_expr)
    row, place = F.struct(*columns), F.struct(*order)
    ends = sliced.groupBy(*keys, "_slice").agg(F.min_by(row, place).alias("_first"), F.max_by(row, place).alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_slice")
    borders = ends.withColumns({"_carry": F.lag("_last").over(along), "_coming": F.lead("_first").over(along)})
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return _joined_on_slice(sliced, borders, keys, ["_carry", "_coming"]).withColumns({
        "_before": F.coalesce(F.lag(row).over(inner), F.col("_carry")),
        "_after": F.coalesce(F.lead(row).over(inner), F.col("_coming"))}).drop("_slice", "_carry", "_coming")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
                slice_expr: Column | None = None) -> DataFrame:
    """Add the sum of ``value`` over the rows of the same key up to each row."""
    sliced = _with_slices(df, keys, order, slice_expr)
    along = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy(*keys, "_slice").agg(F.sum(value).alias("_sum")).withColumn(
        "_earlier", F.coalesce(F.sum("_sum").over(along), F.lit(0)))
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _joined_on_slice(sliced, sums, keys, ["_earlier"]).withColumn(
        out, F.col("_earlier") + F.sum(value).over(inner)).drop("_slice", "_earlier")


def previous_value(df: DataFrame, keys: list[str], order: str | list[str], value: str, slice_expr: Column | None = None,
                   out: str = "previous") -> DataFrame:
    """Add ``value`` of the preceding row of the same key in ``order`` (NULL for the first).

    ``slice_expr``, if given, must be non-decreasing in ``order``; else the slices are ranges.
    """
    order = [order] if isinstance(order, str) else order
    sliced = _with_slices(df, keys, order, slice_expr)
    carry_window = Window.partitionBy(*keys).orderBy("_slice")
    carried = (
        sliced.groupBy(*keys, "_slice").agg(F.max_by(value, F.struct(*order)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(carry_window))
        .select(*keys, "_slice", "_carry")
    )
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
    first = F.row_number().over(inner) == 1
    return (
        sliced.join(carried, [*keys, "_slice"])
        .withColumn(out, F.when(first, F.col("_carry")).otherwise(F.lag(value).over(inner)))
        .drop("_slice", "_carry")
    )


def previous_time(df: DataFrame, keys: list[str], time: str = "time_utc",
                  out: str = "prev_time", width_us: int | None = None) -> DataFrame:
    """The time of the preceding row of the same key; rows of one instant are told apart by all their columns."""
    if width_us:
        return previous_value(df, keys, time, time, time_slice(time, width_us), out)
    tied = df.withColumn("_tie", F.xxhash64(*df.columns))
    return previous_value(tied, keys, [time, "_tie"], time, None, out).drop("_tie")


def row_index(df: DataFrame, order: list[str], slice_expr: Column | None = None, keys: list[str] | None = None,
              out: str = "row_idx") -> DataFrame:
    """Zero-based position in the order given, per key (or over the whole table).

    ``slice_expr``, if given, must be non-decreasing in ``order``; else the slices are ranges. Rows are
    numbered inside each slice and shifted by the row counts of the earlier slices.
    """
    keys = keys or []
    sliced = range_slices(df, [*keys, *order]) if slice_expr is None else df.withColumn("_slice", slice_expr)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    # one row per slice, as many as there are shuffle partitions: one ordered partition is fine
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .drop("_n"))
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        sliced.join(offsets, [*keys, "_slice"])
        .withColumn(out, F.col("_before") + F.row_number().over(inner) - 1)
        .drop("_slice", "_before")
    )
