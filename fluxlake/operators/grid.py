"""Time bins, channel alignment, outage segments and regular regridding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxlake.operators.ordered import keep_one, previous_time

DAY_SECONDS = 86_400


def check_cadence(cadence_min: int) -> int:
    """Seconds of a cadence; it must divide a day so that bins start at midnight."""
    seconds = int(cadence_min) * 60
    if seconds <= 0 or DAY_SECONDS % seconds:
        raise ValueError(f"cadence of {cadence_min} min does not divide a day")
    return seconds


def bin_index(time: str | Column, cadence_min: int) -> Column:
    """Bin number since the epoch."""
    col = F.col(time) if isinstance(time, str) else time
    return F.floor(F.unix_seconds(col) / F.lit(check_cadence(cadence_min))).cast("long")


def bin_time(index: str | Column, cadence_min: int) -> Column:
    col = F.col(index) if isinstance(index, str) else index
    return F.timestamp_seconds(col * F.lit(check_cadence(cadence_min)))


def stored_value(value: Column, transform: str) -> Column:
    """Physical value to stored space: ``log10`` of positive values, else unchanged."""
    if transform == "log10":
        return F.log10(F.when(value > 0, value))
    if transform == "none":
        return value
    raise ValueError(f"unknown transform: {transform}")


def bin_mean(obs: DataFrame, cadence_min: int, keys: list[str] | None = None,
             value: str = "value", time: str = "time_utc", min_count: int = 1,
             transform: str = "none") -> DataFrame:
    """Mean and sample count per key and bin; sparse bins masked; then the transform.

    Partial aggregation leaves at most one row per (task, key, bin) for the shuffle.
    """
    keys = ["series"] if keys is None else keys
    agg = (
        obs.groupBy(*keys, bin_index(time, cadence_min).alias("bin_idx"))
        .agg(F.avg(value).alias("_mean"), F.count(value).alias("n_samples"))
    )
    masked = F.when(F.col("n_samples") >= F.lit(min_count), F.col("_mean"))
    return (
        agg.withColumn("value", stored_value(masked, transform))
        .withColumn("bin_ts", bin_time("bin_idx", cadence_min))
        .drop("_mean")
    )


def bin_mean_wide(obs: DataFrame, channels: list[str], cadence_min: int, channel: str = "series",
                  value: str = "value", time: str = "time_utc", min_count: int = 1,
                  transform: str = "none") -> DataFrame:
    """Binning and alignment in one aggregation: one row per bin, one column per channel.

    Each channel is averaged on its own, so this equals binning first and joining afterwards,
    with a single shuffle of at most one row per (task, bin).
    """
    aggs = []
    for c in channels:
        mine = F.when(F.col(channel) == c, F.col(value))
        masked = F.when(F.count(mine) >= F.lit(min_count), F.avg(mine))
        aggs.append(stored_value(masked, transform).alias(c))
    return (
        obs.filter(F.col(channel).isin(channels))
        .groupBy(bin_index(time, cadence_min).alias("bin_idx")).agg(*aggs)
        .withColumn("bin_ts", bin_time("bin_idx", cadence_min))
    )


def align_channels(bins: DataFrame, channels: list[str], channel: str = "series",
                   on: list[str] | None = None) -> DataFrame:
    """Full outer alignment: one row per bin, one column per channel, in a single shuffle."""
    on = on or ["bin_idx", "bin_ts"]
    cols = [F.max(F.when(F.col(channel) == c, F.col("value"))).alias(c) for c in channels]
    return bins.filter(F.col(channel).isin(channels)).groupBy(*on).agg(*cols)


def all_valid(channels: list[str]) -> Column:
    """A bin counts only when every channel has a value."""
    valid = F.lit(True)
    for c in channels:
        valid = valid & F.col(c).isNotNull()
    return valid


def segments(obs: DataFrame, keys: list[str] | None = None, gap_seconds: int = DAY_SECONDS,
             time: str = "time_utc") -> DataFrame:
    """Stretches of a series without an outage longer than ``gap_seconds``.

    Two samples inside one stretch of time of that length cannot be an outage apart, so the first
    and last time per (key, stretch) decide everything: samples collapse on the map side and the
    ordered window sees at most span / gap rows per key.
    """
    keys = keys or ["series"]
    gap = gap_seconds * 1_000_000
    ends = (obs.groupBy(*keys, F.floor(F.unix_micros(time) / gap).alias("_b"))
            .agg(F.min(time).alias("_first"), F.max(time).alias("_last")))
    order = Window.partitionBy(*keys).orderBy("_b")
    step = F.unix_micros("_first") - F.unix_micros(F.lag("_last").over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ends.withColumn("_opens", F.when(step > gap, 1).otherwise(0))
        .withColumn("segment", F.sum("_opens").over(upto).cast("int"))
        .groupBy(*keys, "segment")
        .agg(F.min("_first").alias("seg_start"), F.max("_last").alias("seg_end"))
    )


def grid_points(segs: DataFrame, step_min: int, time: str = "time_utc") -> DataFrame:
    """Every grid time of each segment, from its first time on in steps of ``step_min``.

    The expansion runs in two levels (blocks, then points), so no array is longer than one
    block of 1,024 points however long the segment is.
    """
    step = int(step_min) * 60
    block = step * 1024
    start, end = F.unix_micros("seg_start"), F.unix_micros("seg_end")
    blocks = segs.withColumn("_from", F.explode(F.sequence(start, end, F.lit(block * 1_000_000))))
    last = F.least(F.col("_from") + F.lit((block - step) * 1_000_000), end)
    return (
        blocks.withColumn("_at", F.explode(F.sequence("_from", last, F.lit(step * 1_000_000))))
        .withColumn(time, F.timestamp_micros("_at"))
        .drop("_from", "_at")
    )


def regrid(obs: DataFrame, step_min: int, order: list[str], keys: list[str] | None = None,
           gap_min: int = 1440, time: str = "time_utc") -> DataFrame:
    """Regular grid inside every segment; no rows are made across outages.

    Keeps the first row of a repeated (key, time); samples off the grid drop out, grid times
    without a sample carry NULL values.
    """
    keys = keys or ["series"]
    first = keep_one(obs, [*keys, time], order, keep="first")
    segs = segments(obs, keys, gap_min * 60, time)
    return grid_points(segs, step_min, time).drop("seg_start", "seg_end").join(
        first, [*keys, time], "left")


def gap_report(before: DataFrame, after: DataFrame, step_min: int, value: str,
               keys: list[str] | None = None, gap_min: int = 1440, time: str = "time_utc",
               width_us: int | None = None) -> DataFrame:
    """Per key: rows before and after regridding, new gap rows, off-cadence steps (must be 0)."""
    keys = keys or ["series"]
    missing = F.count_if(F.col(value).isNull())
    b = before.groupBy(*keys).agg(F.count("*").alias("rows_in"), missing.alias("_miss_in"))
    step = F.unix_micros(time) - F.unix_micros("_prev")
    bad = ((step > 0) & (step != F.lit(step_min * 60_000_000))
           & (step <= F.lit(gap_min * 60_000_000)))
    a = (previous_time(after, keys, time, "_prev", width_us)
         .groupBy(*keys).agg(F.count("*").alias("rows_out"), missing.alias("_miss_out"),
                             F.count_if(bad).alias("off_cadence_steps")))
    return b.join(a, keys).select(
        *keys, "rows_in", "rows_out", (F.col("_miss_out") - F.col("_miss_in")).alias("new_gap_rows"),
        "off_cadence_steps")
