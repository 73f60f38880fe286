"""Baseline forecasts built from the last observed values of each gap-free window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxlake.functions.registry import RUN_KEYS
from fluxlake.operators.grid import bin_time
from fluxlake.operators.terms import test_fold_of
from fluxlake.operators.windows import with_runs

BASELINES = ("persistence", "repeat", "level")


def multi_track_bins(wide: DataFrame, tracks: dict[str, list[str]]) -> DataFrame:
    """Aligned bins to ``(track, channel, bin)`` rows; a track's bin needs all its channels.

    ``wide`` has ``term``, ``bin_idx`` and one column per channel. Tracks are expanded row by row,
    with no join.
    """
    rows = []
    for track, channels in tracks.items():
        valid = F.lit(True)
        for c in channels:
            valid = valid & F.col(c).isNotNull()
        rows += [F.struct(F.lit(track).alias("track"), F.lit(c).alias("channel"),
                          F.when(valid, F.col(c)).alias("value")) for c in channels]
    kept = [c for c in wide.columns if c in ("term", "term_idx", "bin_idx")]
    return (wide.select(*kept, F.explode(F.array(*rows)).alias("_r"))
            .select("_r.track", "_r.channel", *kept, "_r.value")
            .filter(F.col("value").isNotNull()))


def baseline_predictions(bins: DataFrame, conditions: list[tuple[int, int]], cadence_min: int,
                         n_fold: int | None = None, strategy: str = "direct") -> DataFrame:
    """Prediction table of the three baselines for every (seq_len, pred_len) condition.

    ``persistence`` repeats the last observed value, ``repeat`` repeats the last ``pred_len``
    values (its window maximum is occurrence persistence), ``level`` repeats the input mean.
    All conditions share one shuffle and one sort by ``(track, channel, term)``; every window is
    built by row frames inside its run, so the rows are exactly the output. With ``n_fold`` each
    term is predicted in the fold that tests it (``term_idx`` needed), else the fold is 0.
    """
    for seq, pred in conditions:
        if pred > seq:
            raise ValueError(f"pred_len {pred} must not exceed seq_len {seq}")
    keys = ["track", "channel", "term"]
    order = Window.partitionBy(*keys, "run_id").orderBy("bin_idx")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = with_runs(bins, keys).withColumn("_csum", F.sum("value").over(upto))

    def condition(seq: int, pred: int) -> Column:
        mean = (F.lead("_csum", seq - 1).over(order) - F.col("_csum") + F.col("value")) / seq
        return F.struct(
            F.lit(seq).alias("seq_len"), F.lit(pred).alias("pred_len"),
            F.lead("value", seq - 1).over(order).alias("last"), mean.alias("mean"),
            F.collect_list("value").over(order.rowsBetween(seq - pred, seq - 1)).alias("prev"),
            F.collect_list("value").over(order.rowsBetween(seq, seq + pred - 1)).alias("true"))

    # the frames are plain columns of one window step; structs are formed afterwards
    names = []
    framed = runs
    for i, (seq, pred) in enumerate(conditions):
        framed = framed.withColumn(f"_c{i}", condition(seq, pred))
        names.append(f"_c{i}")
    fold = test_fold_of("term_idx", n_fold) if n_fold else F.lit(0)
    windows = (
        framed.select(*keys, fold.alias("fold"), "bin_idx", "run_last",
                      F.explode(F.array(*names)).alias("_w"))
        .filter(F.col("bin_idx") + F.col("_w.seq_len") + F.col("_w.pred_len") - 1
                <= F.col("run_last"))
    )
    n = F.col("_w.pred_len")
    models = F.array(
        F.struct(F.lit("persistence").alias("model"), F.array_repeat("_w.last", n).alias("pred")),
        F.struct(F.lit("repeat").alias("model"), F.col("_w.prev").alias("pred")),
        F.struct(F.lit("level").alias("model"), F.array_repeat("_w.mean", n).alias("pred")))
    return windows.select("*", F.explode(models).alias("_m")).select(
        "track", F.col("_w.seq_len").alias("seq_len"), F.col("_w.pred_len").alias("pred_len"),
        "fold", F.lit(strategy).alias("strategy"), F.col("_m.model").alias("model"), "channel",
        bin_time(F.col("bin_idx") + F.col("_w.seq_len"), cadence_min).alias("forecast_start"),
        F.col("_m.pred").cast("array<float>").alias("pred"),
        F.col("_w.true").cast("array<float>").alias("true"))


__all__ = ["BASELINES", "RUN_KEYS", "baseline_predictions", "multi_track_bins"]
