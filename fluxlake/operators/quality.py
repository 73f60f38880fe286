"""Quality-control tables: rows by role, missing shares, timelines, cadence and fill checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlake.operators.median import grouped_median
from fluxlake.operators.ordered import previous_value
from fluxlake.session import materialize


def rows_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Row counts per key; NULL keys form their own group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"))


def missing_share(df: DataFrame, channels: list[str]) -> DataFrame:
    """Share of NULLs per channel, all channels in one pass."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in channels])
    return shares.unpivot([], channels, "channel", "missing_share")


def timeline(df: DataFrame, key: str, time: str = "time_utc", role: str = "primary") -> DataFrame:
    """First and last time and row count per satellite, for one role."""
    return (df.filter(F.col("role") == role).groupBy(key)
            .agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"),
                 F.count("*").alias("n_rows")))


@dataclass(frozen=True)
class FillRule:
    """Fill attributes of one variable; None where the attribute is absent."""
    fill_value: float | None = None
    missing_value: float | None = None
    valid_min: float | None = None
    valid_max: float | None = None

    def masked(self, col: Column) -> Column:
        hit = F.lit(False)
        for v in (self.fill_value, self.missing_value):
            if v is not None:
                hit = hit | (F.abs(col - v) <= 1e-8 + 1e-5 * abs(v))
        if self.valid_min is not None:
            hit = hit | (col < self.valid_min)
        if self.valid_max is not None:
            hit = hit | (col > self.valid_max)
        return F.coalesce(hit, F.lit(False))


def masked_counts(df: DataFrame, rules: dict[str, FillRule], keys: list[str]) -> DataFrame:
    """Masked samples, samples and masked fraction per key and variable, in one pass."""
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.count_if(r.masked(F.col(c))).alias(c) for c, r in rules.items()])
    return (counts.unpivot([*keys, "n"], list(rules), "variable", "n_masked")
            .withColumn("masked_fraction", F.col("n_masked") / F.col("n")))


def cadence_report(df: DataFrame, keys: list[str], time: str, order: str,
                   slice_expr: Column | None = None) -> DataFrame:
    """Time-axis checks per key in file order: median step, gaps, monotony, coverage.

    Steps wider than 1.5 medians are gaps. The exact median comes from the two-pass sketch, so no
    series is held in one task.
    """
    step = (F.unix_micros(time) - F.unix_micros("_prev")) / 1e6
    # the sketch, the bracket and the report read the steps: they are written, not computed three times
    steps = materialize(previous_value(df.select(*keys, time, order), keys, order, time, slice_expr, "_prev").select(
        *keys, time, step.alias("_step")), "steps")
    # a row per key: written, its size is known before the join, which then leaves the steps in place
    median = materialize(grouped_median(steps, keys, "_step", "cadence_s"), "cadence")
    joined = steps.join(median, keys, "left")
    span = (F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))) / 1e6
    out = joined.groupBy(*keys, "cadence_s").agg(
        F.count("*").alias("n"), F.count_if(F.col("_step") > 1.5 * F.col("cadence_s")).alias("n_gaps"),
        F.coalesce(F.min("_step") > 0, F.lit(True)).alias("monotonic"),
        F.max("_step").alias("max_gap_s"), span.alias("_span"))
    expected = F.rint(F.try_divide("_span", "cadence_s")).cast("long") + 1
    return (out.withColumn("expected_n", expected)
            .withColumn("coverage", F.try_divide(F.col("n"), F.col("expected_n"))).drop("_span"))


def rollup(df: DataFrame, key: str, time: str, sets: list[str]) -> DataFrame:
    """Per satellite: years, distinct labels, span and totals. The label sets are small by nature."""
    labels = [F.array_sort(F.collect_set(c)).alias(f"{c}_set") for c in sets]
    return df.groupBy(key).agg(
        F.array_sort(F.collect_set(F.year(time))).alias("years"), *labels,
        F.min(time).alias("first_time"), F.max(time).alias("last_time"),
        F.count("*").alias("n_rows"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return rows_by(df, keys).filter(F.col("n_rows") > 1)


def assert_unique(df: DataFrame, keys: list[str], what: str = "key") -> DataFrame:
    """The table itself, or an error naming a repeated key."""
    repeated = duplicate_keys(df, keys).limit(3).collect()
    if repeated:
        raise ValueError(f"{what} occurs more than once, e.g. {repeated[0].asDict()}")
    return df


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: files without a record and records without a file."""
    a = left.select(key).distinct()
    b = right.select(key).distinct()
    return (a.join(b, key, "left_anti").withColumn("side", F.lit("left_only"))
            .unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right_only"))))


def checksum_mismatches(recorded: DataFrame, actual: DataFrame, key: str, checksum: str) -> DataFrame:
    """Records whose checksum is not the recomputed one."""
    a, b = recorded.alias("a"), actual.alias("b")
    return (a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"))
            .filter(F.col(f"a.{checksum}") != F.col(f"b.{checksum}"))
            .select(F.col(f"a.{key}").alias(key), F.col(f"a.{checksum}").alias("recorded"),
                    F.col(f"b.{checksum}").alias("actual")))
