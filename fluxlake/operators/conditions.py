"""Run conditions: the grid of runs, what is left to do, shards and ordered model lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxlake.functions.registry import CELL_KEYS, RUN_KEYS

CELL = [*CELL_KEYS, "strategy"]


def condition_grid(spark: SparkSession, values: dict[str, list]) -> DataFrame:
    """All combinations of the argument lists (a few thousand rows), built by exploding."""
    one = spark.range(1)
    for name, options in values.items():
        one = one.withColumn(name, F.explode(F.array(*[F.lit(v) for v in options])))
    return one.drop("id")


def with_models(cells: DataFrame, models: dict[str, list[str]]) -> DataFrame:
    """One row per cell and model of its track and strategy (``track|strategy`` -> models);
    combinations without models drop out."""
    pairs = [x for k, v in models.items() for x in (F.lit(k), F.array(*[F.lit(m) for m in v]))]
    key = F.concat_ws("|", "track", "strategy")
    return cells.withColumn("model", F.explode(F.create_map(*pairs)[key]))


def without(runs: DataFrame, exclusions: list[tuple], columns: list[str]) -> DataFrame:
    """Drop the listed combinations, e.g. ``(model, seq_len)`` pairs."""
    drop = F.lit(False)
    for combo in exclusions:
        same = F.lit(True)
        for c, v in zip(columns, combo, strict=True):
            same = same & F.col(c).eqNullSafe(F.lit(v))
        drop = drop | same
    return runs.filter(~drop)


def pending(runs: DataFrame, rows: DataFrame, predictions: DataFrame,
            keys: list[str] = RUN_KEYS) -> DataFrame:
    """Runs that are not complete; a complete run has a result row and saved predictions."""
    done = rows.select(*keys).distinct().join(predictions.select(*keys).distinct(), keys, "left_semi")
    return runs.join(done, keys, "left_anti")


def unscorable(rows: DataFrame, predictions: DataFrame, keys: list[str] = RUN_KEYS) -> DataFrame:
    """Result rows whose run has no saved predictions."""
    return rows.select(*keys).distinct().join(predictions.select(*keys).distinct(), keys, "left_anti")


def require_scorable(rows: DataFrame, predictions: DataFrame, keys: list[str] = RUN_KEYS) -> None:
    found = unscorable(rows, predictions, keys).limit(3).collect()
    if found:
        raise ValueError(f"result rows without predictions, e.g. {found[0].asDict()}")


def shard(runs: DataFrame, order: list[str], index: int, count: int) -> DataFrame:
    """Every ``count``-th run from ``index`` on. A run list is small: one ordered partition."""
    if not 0 <= index < count:
        raise ValueError(f"shard index must be in [0, {count}); got {index}")
    pos = F.row_number().over(Window.orderBy(*order)) - 1
    return runs.withColumn("_pos", pos).filter(F.col("_pos") % count == index).drop("_pos")


def models_by_cell(runs: DataFrame, position: str, cell: list[str] = CELL) -> DataFrame:
    """Cell -> list of its models in the order of ``position``; at most all models per cell."""
    listed = F.array_sort(F.collect_list(F.struct(position, "model")))
    return runs.groupBy(*cell).agg(F.min(position).alias("first_position"),
                                   F.transform(listed, lambda x: x["model"]).alias("models"))
