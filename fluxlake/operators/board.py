"""Master tables and leaderboards: one row per run in, one row per (cell, model) out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxlake.functions.metrics import STANDARD
from fluxlake.functions.registry import COUNTS, RUN_KEYS
from fluxlake.operators.conditions import without
from fluxlake.operators.quality import assert_unique

# The run left out of every mean, the unit shown on the board, the tie tolerance.
EXCLUDED = [("xpatch", 2016)]
BOARD_UNIT = "day"
TIE = 1e-12
# Two-sided 95 % quantiles of Student's t for 1 to 30 degrees of freedom.
T_975 = [12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851,
         2.364624252, 2.306004135, 2.262157163, 2.228138852, 2.200985160, 2.178812830,
         2.160368656, 2.144786688, 2.131449546, 2.119905299, 2.109815578, 2.100922040,
         2.093024054, 2.085963447, 2.079613845, 2.073873068, 2.068657610, 2.063898562,
         2.059538553, 2.055529439, 2.051830516, 2.048407142, 2.045229642, 2.042272456]
Z_975 = 1.959963985


def records_to_rows(records: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Rows of one table (``regression`` or ``event``) out of nested result records.

    Records of another format are left out; ``n_foreign_records`` tells how many there are.
    """
    current = records.filter(F.col("format").eqNullSafe(2))
    extra = ["best_val_loss"] if table == "regression" else []
    return current.select(*keys, *extra, F.explode(table).alias("_r")).select(*keys, *extra, "_r.*")


def n_foreign_records(records: DataFrame) -> int:
    return records.filter(~F.col("format").eqNullSafe(2)).count()


def merge_masters(tables: list[DataFrame], columns: list[str], row_key: list[str]) -> DataFrame:
    """Union of master tables in run order. Another column set or a repeated run is an error."""
    if not tables:
        raise ValueError("no master tables to merge")
    for t in tables:
        if set(t.columns) != set(columns):
            raise ValueError(f"not a master table of this layout: {sorted(set(t.columns) ^ set(columns))}")
    merged = reduce(DataFrame.unionByName, [t.select(*columns) for t in tables])
    counts = [F.col(c).cast("long").alias(c) if c in COUNTS else F.col(c) for c in columns]
    return assert_unique(merged, row_key, "run").select(*counts).orderBy(*RUN_KEYS)


def carry_over(new_rows: DataFrame, old_rows: DataFrame, column: str, keys: list[str] = RUN_KEYS) -> DataFrame:
    """Take a column that cannot be recomputed from the previous rows of the same run."""
    old = old_rows.groupBy(*keys).agg(F.max(column).alias(column))
    return new_rows.drop(column).join(old, keys, "left")


def best_first(rows: DataFrame, metric: str, groups: list[str], out: str = "rank") -> DataFrame:
    """Rank rows inside each group, best on top whatever the direction, NULL last."""
    key = F.col(metric).asc_nulls_last() if STANDARD.ascends(metric) else F.col(metric).desc_nulls_last()
    return rows.withColumn(out, F.row_number().over(
        Window.partitionBy(*groups).orderBy(key, *RUN_KEYS)))


def best_of(metric: str, groups: list[str]) -> Column:
    """True for the best value of its group, ties within 1e-12 included."""
    w = Window.partitionBy(*groups)
    best = F.min(metric).over(w) if STANDARD.ascends(metric) else F.max(metric).over(w)
    return F.abs(F.col(metric) - best) <= TIE


def cell_means(rows: DataFrame, metrics: list[str], exclusions: list[tuple] | None = None) -> DataFrame:
    """Per (track, pred_len, channel, model): mean and number of defined values, and rows."""
    kept = without(rows, EXCLUDED if exclusions is None else exclusions, ["model", "seq_len"])
    aggs = [a for m in metrics for a in (F.avg(m).alias(m), F.count(m).alias(f"{m}_defined"))]
    return kept.groupBy("track", "pred_len", "channel", "model").agg(*aggs, F.count("*").alias("n_rows"))


def run_grid(*tables: DataFrame) -> DataFrame:
    """Distinct (fold, seq_len) runs of any model per track and horizon, over all tables."""
    keys = ["track", "pred_len", "fold", "seq_len"]
    return reduce(DataFrame.union, [t.select(*keys) for t in tables]).distinct()


def shortfall(*tables: DataFrame) -> DataFrame:
    """Grid runs each listed model lacks: ``track, pred_len, model, fold, seq_len``."""
    keys = ["track", "pred_len", "fold", "seq_len"]
    have = reduce(DataFrame.union, [t.select(*keys, "model") for t in tables]).distinct()
    models = have.select("track", "pred_len", "model").distinct()
    wanted = run_grid(*tables).join(models, ["track", "pred_len"])
    return wanted.join(have, [*keys, "model"], "left_anti")


def left_out(rows: DataFrame, exclusions: list[tuple] | None = None) -> DataFrame:
    """Number of distinct runs per horizon that the exclusions leave out of the means."""
    kept = without(rows, EXCLUDED if exclusions is None else exclusions, ["model", "seq_len"])
    dropped = rows.select("pred_len", *[k for k in RUN_KEYS if k != "pred_len"]).join(
        kept.select(*RUN_KEYS).distinct(), RUN_KEYS, "left_anti")
    return dropped.groupBy("pred_len").agg(F.countDistinct(F.struct(*RUN_KEYS)).alias("n_left_out"))


def on_run_grid(cells: DataFrame, rows: DataFrame, excluded: list) -> DataFrame:
    """Cells of every model and channel of a (track, horizon) with ``n_grid``, the runs of all its models.

    A model without rows for a channel gets a cell of NULLs.
    """
    place = ["track", "pred_len"]
    runs = without(rows, excluded, ["model", "seq_len"])
    grid = runs.groupBy(*place).agg(F.countDistinct("seq_len", "fold").alias("n_grid"))
    models = runs.select(*place, "model").distinct()
    listed = models.join(runs.select(*place, "channel").distinct(), place).join(grid, place)
    return listed.join(cells, [*place, "channel", "model"], "left")


def board(means: DataFrame, order_channel: dict[str, str], metric: str = "rmse") -> DataFrame:
    """Board position of each model per (track, horizon): the first channel's mean, NULL last,
    then the name."""
    first = F.create_map(*[x for k, v in order_channel.items() for x in (F.lit(k), F.lit(v))])
    lead = (means.filter(F.col("channel") == first[F.col("track")])
            .select("track", "pred_len", "model", F.col(metric).alias("_lead")))
    listed = means.select("track", "pred_len", "model").distinct().join(
        lead, ["track", "pred_len", "model"], "left")
    w = Window.partitionBy("track", "pred_len").orderBy(F.col("_lead").asc_nulls_last(), "model")
    return listed.withColumn("position", F.row_number().over(w)).drop("_lead")


def pivot_board(means: DataFrame, metric: str, channels: list[str], horizons: list[int]) -> DataFrame:
    """Models x (channel, horizon); the column list is fixed, so no pass is spent on finding it."""
    label = F.concat_ws("_", "channel", F.col("pred_len").cast("string"))
    names = [f"{c}_{h}" for c in channels for h in horizons]
    return (means.withColumn("_col", label).groupBy("track", "model")
            .pivot("_col", names).agg(F.first(metric)))


def t_quantile(df: Column) -> Column:
    """97.5 % quantile of Student's t: exact table to 30 degrees, then a series in 1/df."""
    table = F.array(*[F.lit(x) for x in T_975])
    z, v = Z_975, df.cast("double")
    series = (z + F.lit((z**3 + z) / 4) / v + F.lit((5 * z**5 + 16 * z**3 + 3 * z) / 96) / (v * v)
              + F.lit((3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384) / (v * v * v))
    return F.when(df < 1, None).when(df <= 30, F.get(table, (df - 1).cast("int"))).otherwise(series)


def fold_ci(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean over folds, 95 % half width and number of defined folds per key and metric."""
    aggs = []
    for m in metrics:
        n = F.count(m)
        half = F.try_divide(F.stddev_samp(m) * t_quantile(n - 1), F.sqrt(n))
        aggs += [F.avg(m).alias(f"{m}_mean"), F.when(n > 1, half).alias(f"{m}_ci"),
                 n.alias(f"{m}_nfold")]
    return rows.groupBy(*keys).agg(*aggs)


def champions(cells: DataFrame, keys: list[str], metric: str, ci: str) -> DataFrame:
    """Best model per cell, the runner-up, their gap and whether the intervals overlap.

    ``cells`` has one row per (cell, model) with the mean ``metric`` and its half width ``ci``.
    """
    down = not STANDARD.ascends(metric)
    col = F.col(metric)
    w = Window.partitionBy(*keys).orderBy(
        col.desc_nulls_last() if down else col.asc_nulls_last(), "model")
    ranked = cells.withColumn("_k", F.row_number().over(w))
    nxt = lambda c: F.lead(c).over(w)
    gap = (col - nxt(metric)) if down else (nxt(metric) - col)
    return (
        ranked.withColumn("runner_up", nxt("model")).withColumn("gap", gap)
        .withColumn("overlap", F.col("gap") <= F.col(ci) + nxt(ci))
        .filter(F.col("_k") == 1)
        .select(*keys, F.col("model").alias("champion"), metric, ci, "runner_up", "gap", "overlap")
    )


def standings(cells: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Wins, average rank and number of cells per model."""
    col = F.col(metric)
    w = Window.partitionBy(*keys).orderBy(
        col.asc_nulls_last() if STANDARD.ascends(metric) else col.desc_nulls_last(), "model")
    ranked = cells.filter(col.isNotNull()).withColumn("_k", F.row_number().over(w))
    return ranked.groupBy("model").agg(F.count_if(F.col("_k") == 1).alias("wins"),
                                       F.avg("_k").alias("avg_rank"), F.count("*").alias("n_cells"))
