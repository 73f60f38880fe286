"""Gap-free look-back/forecast windows on a regular grid.

Inputs are binned tables, one row per valid bin, so a partition ``(series, term)`` holds at most
(term length / cadence) rows. Windows are found from runs of consecutive bins in one ordered
pass whatever the window length is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxlake.operators.ordered import row_index

GROUP = ["series", "term"]


def with_runs(valid_bins: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Tag each valid bin with its run of consecutive bins: id, first and last bin."""
    keys = keys or GROUP
    order = Window.partitionBy(*keys).orderBy("bin_idx")
    run = Window.partitionBy(*keys, "run_id")
    return (
        valid_bins.withColumn("run_id", F.col("bin_idx") - F.row_number().over(order))
        .withColumn("run_first", F.min("bin_idx").over(run))
        .withColumn("run_last", F.max("bin_idx").over(run))
    )


def run_table(valid_bins: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per run with its length in bins."""
    keys = keys or GROUP
    order = Window.partitionBy(*keys).orderBy("bin_idx")
    return (
        valid_bins.withColumn("run_id", F.col("bin_idx") - F.row_number().over(order))
        .groupBy(*keys, "run_id")
        .agg(F.min("bin_idx").alias("run_first"), F.count("*").alias("run_len"))
        .drop("run_id")
    )


def fits(length: int | Column) -> Column:
    """True where a window of ``length`` bins starting at this bin stays inside its run."""
    return F.col("bin_idx") + F.lit(length) - 1 <= F.col("run_last")


def window_starts(valid_bins: DataFrame, seq_len: int, pred_len: int,
                  keys: list[str] | None = None) -> DataFrame:
    """Starts of all gap-free windows, with the bin of the first forecast step."""
    return (
        with_runs(valid_bins, keys).filter(fits(seq_len + pred_len))
        .withColumn("forecast_idx", F.col("bin_idx") + F.lit(seq_len))
        .drop("run_id", "run_first", "run_last")
    )


def window_counts(runs: DataFrame, lengths: list[dict[str, int]],
                  keys: list[str] | None = None) -> DataFrame:
    """Number of windows per key for every entry of ``lengths`` (each with a ``length``).

    Pure arithmetic on run lengths: one run table serves the whole sweep, each run being expanded
    to the entries in place.
    """
    keys = keys or GROUP
    names = list(lengths[0])
    expanded = runs.withColumn("_len", F.explode(F.array(*[
        F.struct(*[F.lit(entry[n]).alias(n) for n in names]) for entry in lengths])))
    fit = F.greatest(F.lit(0), F.col("run_len") - F.col("_len.length") + 1)
    return (
        expanded.groupBy(*keys, *[F.col(f"_len.{n}").alias(n) for n in names])
        .agg(F.sum(fit).alias("n_windows"))
    )


def run_stats(runs: DataFrame, grid: DataFrame, keys: list[str], long_run: int) -> DataFrame:
    """Per key: share of valid bins, median / 90 % / longest run, runs of at least ``long_run``.

    ``grid`` has the bins between the first and last time of each term: ``n_bins`` per key.
    """
    stats = runs.groupBy(*keys).agg(
        F.sum("run_len").alias("n_valid"), F.count("*").alias("n_runs"),
        F.expr("percentile(run_len, 0.5)").alias("median_run"),
        F.expr("percentile(run_len, 0.9)").alias("p90_run"),
        F.max("run_len").alias("max_run"), F.count_if(F.col("run_len") >= long_run).alias("n_long"))
    return stats.join(grid, keys).withColumn("valid_pct", F.col("n_valid") / F.col("n_bins") * 100)


def window_arrays(valid_bins: DataFrame, seq_len: int, pred_len: int,
                  keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Each window with its input and target values as arrays (opt-in: output is L x input).

    A row frame inside the run collects exactly the output values, with no join and no shuffle
    beyond the one on ``keys``.
    """
    keys = keys or GROUP
    order = Window.partitionBy(*keys, "run_id").orderBy("bin_idx")
    x = F.collect_list(value).over(order.rowsBetween(0, seq_len - 1))
    y = F.collect_list(value).over(order.rowsBetween(seq_len, seq_len + pred_len - 1))
    return (
        with_runs(valid_bins, keys).withColumn("x", x).withColumn("y", y)
        .filter(fits(seq_len + pred_len))
        .withColumn("forecast_idx", F.col("bin_idx") + F.lit(seq_len))
        .select(*keys, "bin_idx", "forecast_idx", "x", "y")
    )


def dense_windows(obs: DataFrame, seq_len: int, pred_len: int, order: list[str],
                  keys: list[str] | None = None, time: str = "time_utc") -> DataFrame:
    """Windows over the row order of each key, without a gap rule: one row per window.

    The row kept is the first forecast row of its window; keys with too few rows have no window.
    """
    keys = keys or ["term"]
    numbered = row_index(obs, order, keys=keys)
    sizes = obs.groupBy(*keys).agg(F.count("*").alias("_size"))
    return (
        numbered.join(sizes, keys)
        .filter((F.col("row_idx") >= seq_len) & (F.col("row_idx") + pred_len <= F.col("_size")))
        .withColumn("window_idx", F.col("row_idx") - seq_len)
        .withColumnRenamed(time, "forecast_start").drop("row_idx", "_size")
    )
