"""Scores of prediction tables per channel and per evaluation unit.

A prediction table has one row per window and channel: the run keys, ``channel``,
``forecast_start`` and the arrays ``pred`` and ``true`` (float, stored space). Everything but the
medians and the daily cut comes from a single pass with one partial aggregation, so the exploded
values never cross a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlake.functions.metrics import STANDARD, MetricSet
from fluxlake.functions.registry import COUNTS, REGRESSION_KEYS, RUN_KEYS
from fluxlake.functions.scores import score_columns
from fluxlake.operators.daycut import DAY_HOURS, spaced_starts
from fluxlake.operators.grid import stored_value
from fluxlake.operators.median import grouped_medians

GRANULARITIES = ("point", "window", "day")


@dataclass
class Evaluation:
    regression: DataFrame
    event: DataFrame


def by_channel(values: dict[str, float], kind: str, transform: str = "none") -> Column:
    """The channel's value, in stored space."""
    pairs = [c for k, v in values.items() for c in (F.lit(k), stored_value(F.lit(float(v)), transform).cast(kind))]
    return F.create_map(*pairs)[F.col("channel")]


def non_finite(col: Column) -> Column:
    return col.isNull() | F.isnan(col) | (F.abs(col) == F.lit(float("inf")))


def to_long(pred: DataFrame, keys: list[str] = RUN_KEYS) -> DataFrame:
    """One row per (window, lead): for consumers that want single values."""
    return pred.select(
        *keys, "channel", "forecast_start",
        F.posexplode(F.arrays_zip("pred", "true")).alias("lead", "_v"),
    ).select(*keys, "channel", "forecast_start", "lead", F.col("_v.pred").alias("pred"),
             F.col("_v.true").alias("true"))


def from_long(long: DataFrame, keys: list[str] = RUN_KEYS) -> DataFrame:
    """Back to one row per window; a window has ``pred_len`` rows, so the groups are small."""
    return (
        long.groupBy(*keys, "channel", "forecast_start")
        .agg(F.array_sort(F.collect_list(F.struct("lead", "pred", "true"))).alias("_v"))
        .select(*keys, "channel", "forecast_start", F.col("_v.pred").alias("pred"),
                F.col("_v.true").alias("true"))
    )


def check_predictions(pred: DataFrame) -> DataFrame:
    """Fail on a window whose arrays differ in length from each other or from ``pred_len``."""
    ok = (F.size("pred") == F.col("pred_len")) & (F.size("true") == F.col("pred_len"))
    return pred.withColumn("pred", F.when(ok, F.col("pred")).otherwise(
        F.raise_error(F.lit("pred and true must both hold pred_len values"))))


def _unit_rows(pred: DataFrame, thresholds: dict[str, float], transform: str) -> DataFrame:
    """Window-level flags: predicted and observed event, any non-finite value."""
    # the threshold is compared at float precision, like the stored values
    thr = by_channel(thresholds, "float", transform)
    return (
        pred.withColumn("pred", F.col("pred").cast("array<float>"))
        .withColumn("true", F.col("true").cast("array<float>"))
        .withColumn("thr", thr)
        .withColumn("w_pred", F.array_max("pred") >= F.col("thr"))
        .withColumn("w_true", F.array_max("true") >= F.col("thr"))
        .withColumn("w_bad", F.exists("pred", non_finite))
    )


def _counts(p: Column, t: Column, bad: Column, member: Column, prefix: str) -> list[Column]:
    return [
        F.count_if(member).alias(f"{prefix}_n"),
        F.count_if(member & bad).alias(f"{prefix}_bad"),
        F.count_if(member & p & t).alias(f"{prefix}_tp"),
        F.count_if(member & p & ~t).alias(f"{prefix}_fp"),
        F.count_if(member & ~p & t).alias(f"{prefix}_fn"),
    ]


def _arguments(space: str, transform: str) -> tuple[Column, Column]:
    p, t = F.col("p").cast("double"), F.col("t").cast("double")
    return (p, t) if space == "stored" or transform == "log10" else (F.log10(p), F.log10(t))


def _metric_columns(known: MetricSet, names: list[str], transform: str) -> list[Column]:
    return [known.regressions[n](*_arguments(known.regressions[n].facts["space"], transform)).alias(f"m_{n}")
            for n in names if "median_of" not in known.regressions[n].facts]


def _medians(long: DataFrame, keys: list[str], known: MetricSet, names: list[str], transform: str) -> DataFrame | None:
    cols = []
    for n in names:
        facts = known.regressions[n].facts
        if "median_of" in facts:
            v = facts["median_of"](*_arguments(facts["space"], transform))
            # a channel with such a value is voided as a whole, its medians are not used
            cols.append(F.when(~non_finite(v), v).alias(f"d_{n}"))
    wanted = [f"d_{n}" for n in names if "median_of" in known.regressions[n].facts]
    return grouped_medians(long.select(*keys, *cols), keys, wanted) if wanted else None


def evaluate(pred: DataFrame, thresholds: dict[str, float] | None, transform: str = "log10",
             keys: list[str] = RUN_KEYS, day_hours: int = DAY_HOURS, metrics: Sequence[str] | None = None,
             units: Sequence[str] = GRANULARITIES, known: MetricSet = STANDARD) -> Evaluation:
    """One regression row per run and channel, one event row per run, channel and unit.

    ``thresholds`` are physical values by channel. One non-finite prediction voids every score and
    count of its channel in all units. Metrics not selected stay in the tables as NULL columns.
    Only the ``units`` asked for are computed; the daily cut runs on each run's own starts.
    """
    chosen = known.chosen(metrics)
    reg_names = [n for n in known.regressions if n in chosen]
    event_names = [n for n in known.events if n in chosen]
    group = [*keys, "channel"]
    flags = _unit_rows(pred, thresholds or {"": 1.0}, transform)
    long = flags.select(
        *group, "thr", "w_pred", "w_true", "w_bad",
        F.posexplode(F.arrays_zip("pred", "true")).alias("lead", "_v"),
    ).select(*group, "thr", "w_pred", "w_true", "w_bad", "lead",
             F.col("_v.pred").alias("p"), F.col("_v.true").alias("t"))
    point = F.lit(True)
    first = F.col("lead") == 0
    summary = long.groupBy(*group).agg(
        *_counts(F.col("p") >= F.col("thr"), F.col("t") >= F.col("thr"), non_finite(F.col("p")),
                 point, "point"),
        *_counts(F.col("w_pred"), F.col("w_true"), F.col("w_bad"), first, "window"),
        F.count_if((F.col("p") <= 0) | (F.col("t") <= 0)).alias("n_nonpositive"),
        *_metric_columns(known, reg_names, transform),
    )
    return Evaluation(
        regression=_regression_rows(summary, long, group, known, reg_names, transform),
        event=_event_rows(summary, flags, keys, thresholds, day_hours, known, event_names, units),
    )


def _regression_rows(summary, long, group, known, names, transform) -> DataFrame:
    med = _medians(long.select(*group, "p", "t"), group, known, names, transform)
    rows = summary if med is None else summary.join(med, group, "left")
    finite = F.col("point_bad") == 0
    loggable = finite if transform == "log10" else finite & (F.col("n_nonpositive") == 0)
    cols = []
    for name, metric in known.regressions.items():
        if name not in names:
            cols.append(F.lit(None).cast("double").alias(name))
            continue
        raw = metric(F.col(f"d_{name}")) if "median_of" in metric.facts else F.col(f"m_{name}")
        cols.append(F.when(finite if metric.facts["space"] == "stored" else loggable, raw).alias(name))
    return rows.select(*group, F.col("point_n").alias("n"), *cols)


def _first_of_repeats(flags: DataFrame, group: list[str]) -> DataFrame:
    """One window per start: the one with the lowest ``position`` where the table has that column,
    else the smallest by its values."""
    order = ["position"] if "position" in flags.columns else []
    first = F.min(F.struct(*order, "w_pred", "w_true", "w_bad", "pred", "true")).alias("_first")
    return flags.groupBy(*group, "forecast_start").agg(first).select(
        *group, "forecast_start", "_first.w_pred", "_first.w_true", "_first.w_bad")


def _event_rows(summary, flags, keys, thresholds, day_hours, known, names, units) -> DataFrame:
    group = [*keys, "channel"]
    shown = [u for u in GRANULARITIES if u in units]
    if "day" in shown and not (thresholds and "forecast_start" in flags.columns):
        shown.remove("day")
    if "day" in shown:
        kept = spaced_starts(flags.select(*keys, "forecast_start"), keys, hours=day_hours)
        # the cut throws most windows away: they go before repeats are told apart by their values
        day = (
            _first_of_repeats(flags.join(kept, [*keys, "forecast_start"], "left_semi"), group)
            .groupBy(*group)
            .agg(*_counts(F.col("w_pred"), F.col("w_true"), F.col("w_bad"), F.lit(True), "day"))
        )
        summary = summary.join(day, group, "left")
    ok = F.col("point_bad") == 0
    structs = []
    for unit in shown:
        n, tp, fp, fn = (F.col(f"{unit}_{c}") for c in ("n", "tp", "fp", "fn"))
        structs.append(F.struct(
            F.lit(unit).alias("granularity"), n.alias("n"),
            F.when(ok, tp + fn).alias("n_events"), F.when(ok, tp).alias("tp"),
            F.when(ok, fp).alias("fp"), F.when(ok, fn).alias("fn"),
            F.when(ok, n - tp - fp - fn).alias("tn"), F.col(f"{unit}_bad").alias("n_nonfinite")))
    rows = summary.select(*group, F.explode(F.array(*structs)).alias("_u")).select(*group, "_u.*")
    threshold = (by_channel(thresholds, "double") if thresholds
                 else F.lit(None).cast("double"))
    rows = rows.withColumn("threshold", threshold)
    unselected = [F.lit(None).cast("double").alias(n) for n in known.events if n not in names]
    rows = rows.select("*", *score_columns(names, known.events), *unselected)
    if not thresholds:
        rows = rows.filter(F.lit(False))
    return rows.select(*group, "granularity", "threshold", *COUNTS, *known.events)


def master_layout(evaluation: Evaluation, best_val_loss: Column | None = None, known: MetricSet = STANDARD) -> Evaluation:
    """Both tables in the column order of the master tables."""
    loss = best_val_loss if best_val_loss is not None else F.lit(None).cast("double")
    reg = evaluation.regression.withColumn("best_val_loss", loss)
    return Evaluation(regression=reg.select(*known.regression_columns),
                      event=evaluation.event.select(*known.event_columns))


__all__ = ["COUNTS", "Evaluation", "GRANULARITIES", "REGRESSION_KEYS", "by_channel", "check_predictions",
           "evaluate", "from_long", "master_layout", "non_finite", "to_long"]
