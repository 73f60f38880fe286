"""Smoothing, decomposition, normalisation, patching and pooling of binned series.

Recurrences are linear in their state, so a run of rows is a map ``state -> matrix @ state + offset`` and maps
compose. A series is cut into slices of the bin number, a slice of rows becomes one row with its map, and
``LEVEL`` slices become one row again. States at the borders follow from the top down, and each slice then walks from
its own state. All of it is folds over arrays of bounded length in the JVM. Frames and pools likewise work on slices
of positions; a frame's slice has a halo of the rows beside it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-5
SLICE = 2048
# rows of a recurrence's slice, and slices of one step up: an array of a series' steps has a millionth of its rows
FOLD, LEVEL = 256, 4096


@dataclass(frozen=True)
class Recurrence:
    """``state = move @ state + gain * value`` per row; the first component is the trend.

    The state before the first row is ``initial``, or, where that is missing, what makes the first
    state (first value, first difference).
    """

    move: np.ndarray
    gain: np.ndarray
    initial: np.ndarray | None = None

    @property
    def size(self) -> int:
        return len(self.gain)

    def step(self, state: list[Column], value: Column) -> list[Column]:
        return [_dot(row, state) + F.lit(float(g)) * value for row, g in zip(self.move, self.gain, strict=True)]

    def powers(self, rows: int) -> list[np.ndarray]:
        """``move`` to the powers 0 … ``rows``."""
        out = [np.eye(self.size)]
        for _ in range(rows):
            out.append(self.move @ out[-1])
        return out


def _dot(weights: np.ndarray, values: list[Column]) -> Column:
    return reduce(Column.__add__, [F.lit(float(w)) * v for w, v in zip(weights, values, strict=True)])


def _sliced(df: DataFrame, keys: list[str], order: str, value: str, width: int) -> DataFrame:
    return df.select(*keys, F.col(order).cast("long").alias(order), F.col(value).cast("double").alias(value),
                     F.floor(F.col(order) / width).cast("long").alias("_slice"))


def _parts(of: Column, names: list[str]) -> list[Column]:
    return [of[n] for n in names]


def _composed(maps: Column, size: int) -> Column:
    """One map from an array of maps ``(_slice, matrix, offset)`` in order; matrices by rows."""
    def then(total: Column, m: Column) -> Column:
        row = lambda i: [m["matrix"][i * size + j] for j in range(size)]
        times = lambda i, vector: reduce(Column.__add__, [a * b for a, b in zip(row(i), vector, strict=True)])
        column = lambda j: [total["matrix"][k * size + j] for k in range(size)]
        offset = [total["offset"][j] for j in range(size)]
        return F.struct(
            F.array(*[times(i, column(j)) for i in range(size) for j in range(size)]).alias("matrix"),
            F.array(*[times(i, offset) + m["offset"][i] for i in range(size)]).alias("offset"))

    unit = F.struct(F.array(*[F.lit(float(x)) for x in np.eye(size).ravel()]).alias("matrix"),
                    F.array(*[F.lit(0.0)] * size).alias("offset"))
    return F.aggregate(maps, unit, then)


def _states(maps: Column, begin: Column, size: int) -> Column:
    """``(_slice, state)`` before each map of an ordered array, from the state before the first."""
    def then(total: Column, m: Column) -> Column:
        after = F.array(*[reduce(Column.__add__, [m["matrix"][i * size + j] * total["state"][j] for j in range(size)])
                          + m["offset"][i] for i in range(size)])
        return F.struct(after.alias("state"), F.array_append(
            total["out"], F.struct(m["_slice"].alias("_slice"), total["state"].alias("state"))).alias("out"))

    none = F.slice(F.array(F.struct(F.lit(0).cast("long").alias("_slice"), begin.alias("state"))), 1, 0)
    return F.aggregate(maps, F.struct(begin.alias("state"), none.alias("out")), then)["out"]


def _listed(maps: DataFrame, keys: list[str]) -> DataFrame:
    row = F.struct("_slice", "matrix", "offset")
    return maps.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("maps"))


def _first_states(slices: DataFrame, keys: list[str], rule: Recurrence, order: str, value: str) -> DataFrame:
    """``keys, _first`` (the first row's order) and ``_begin``, the state after the first row."""
    heads = slices.select(*keys, F.explode(F.slice("rows", 1, 2)).alias("_row"))
    first = heads.groupBy(*keys).agg(F.min("_row").alias("_row"))
    if rule.initial is not None:
        begin = rule.step([F.lit(float(x)) for x in rule.initial], F.col(f"_row.{value}"))
    elif rule.size == 1:
        begin = [F.col(f"_row.{value}")]
    else:
        # the second row of a series is the first or second of its slice
        own = first.select(*[F.col(k).alias(f"_own_{k}") for k in keys], F.col(f"_row.{order}").alias("_own_first"))
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_own_{k}")) for k in keys])
        second = heads.join(own, same & (F.col(f"_row.{order}") > F.col("_own_first"))).groupBy(
            *[f"_own_{k}" for k in keys]).agg(F.min("_row").alias("_next"))
        same = reduce(Column.__and__, [first[k].eqNullSafe(second[f"_own_{k}"]) for k in keys])
        first = first.join(second, same, "left").select(*keys, "_row", "_next")
        begin = [F.col(f"_row.{value}"), F.coalesce(F.col(f"_next.{value}") - F.col(f"_row.{value}"), F.lit(0.0))]
    return first.select(*keys, F.col(f"_row.{order}").alias("_first"), F.array(*begin).alias("_begin"))


def linear_recurrence(df: DataFrame, keys: list[str], rule: Recurrence, order: str, value: str, out: str,
                      fold: int = FOLD, level: int = LEVEL) -> DataFrame:
    """``keys, order, value`` and the first component of the state after each row."""
    size = rule.size
    slices = _sliced(df, keys, order, value, fold).groupBy(*keys, "_slice").agg(
        F.sort_array(F.collect_list(F.struct(order, value))).alias("rows"))
    firsts = _first_states(slices, keys, rule, order, value)
    # the first row of a series is done; its slice goes on with the second
    opens = F.col("_slice") == F.floor(F.col("_first") / fold)
    body = F.when(opens, F.slice("rows", 2, fold)).otherwise(F.col("rows"))
    slices = slices.join(firsts, keys).select(*keys, "_slice", "_begin", opens.alias("_opens"), F.col("rows")[0].alias("head"), body.alias("rows"))

    powers = F.array(*[F.array(*[F.lit(float(x)) for x in p.ravel()]) for p in rule.powers(fold)])
    zero = F.array(*[F.lit(0.0)] * size)
    walk = lambda state, r: F.array(*rule.step([state[i] for i in range(size)], r[value]))
    maps = slices.select(*keys, "_slice", "_begin", F.element_at(powers, F.size("rows") + 1).alias("matrix"),
                         F.aggregate("rows", zero, walk).alias("offset"))

    # up: one map for every LEVEL slices; down: states before these, then before each slice
    groups = _listed(maps.withColumn("_group", F.floor(F.col("_slice") / level).cast("long")), [*keys, "_begin", "_group"])
    tops = groups.select(*keys, "_begin", F.col("_group").alias("_slice"), _composed(F.col("maps"), size).alias("_map")).select(
        *keys, "_begin", "_slice", "_map.*")
    top_states = _listed(tops, [*keys, "_begin"]).select(
        *keys, F.explode(_states(F.col("maps"), F.col("_begin"), size)).alias("_top")).select(
        *keys, F.col("_top._slice").alias("_group"), F.col("_top.state").alias("_state"))
    borders = groups.drop("_begin").join(top_states, [*keys, "_group"]).select(
        *keys, F.explode(_states(F.col("maps"), F.col("_state"), size)).alias("_at")).select(*keys, "_at.*")

    def walked(total: Column, r: Column) -> Column:
        after = walk(total["state"], r)
        return F.struct(after.alias("state"), F.array_append(total["out"], after[0]).alias("out"))

    # a slice that opens a series has the first row's trend before the rest
    start = F.when(F.col("_opens"), F.array(F.col("state")[0])).otherwise(F.slice(F.array(F.lit(0.0)), 1, 0))
    trend = F.aggregate("rows", F.struct(F.col("state").alias("state"), start.alias("out")), walked)["out"]
    rows = F.when(F.col("_opens"), F.concat(F.array("head"), "rows")).otherwise(F.col("rows"))
    done = slices.join(borders, [*keys, "_slice"]).select(
        *keys, F.explode(F.arrays_zip(rows.alias("r"), trend.alias("t"))).alias("_z"))
    return done.select(*keys, F.col(f"_z.r.{order}").alias(order), F.col(f"_z.r.{value}").alias(value), F.col("_z.t").alias(out))


def positions(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``keys, order, value`` with ``_pos`` in the series and its length ``_len``, by counts per slice."""
    rows = _sliced(df, keys, order, value, SLICE)
    counts = rows.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    along = Window.partitionBy(*keys).orderBy("_slice")
    before = F.sum("_n").over(along) - F.col("_n")
    carried = counts.select(*keys, "_slice", before.alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_len"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(order)) - 1
    return rows.withColumn("_inside", inside).join(carried, [*keys, "_slice"]).select(
        *keys, order, value, "_slice", (F.col("_before") + F.col("_inside")).alias("_pos"), "_len")


def ema(df: DataFrame, keys: list[str], alpha: float, order: str = "bin_idx",
        value: str = "value") -> DataFrame:
    """Exponential moving average from the first value on, and what is left of the series."""
    rule = Recurrence(np.array([[1 - alpha]]), np.array([alpha]))
    return linear_recurrence(df, keys, rule, order, value, "trend").withColumn("residual", F.col(value) - F.col("trend"))


def double_ema(df: DataFrame, keys: list[str], alpha: float, beta: float, order: str = "bin_idx",
               value: str = "value") -> DataFrame:
    """Level and slope smoothing; the slope starts as the first difference."""
    keep = 1 - alpha
    rule = Recurrence(np.array([[keep, keep], [beta * (keep - 1), beta * keep + 1 - beta]]), np.array([alpha, alpha * beta]))
    return linear_recurrence(df, keys, rule, order, value, "trend").withColumn("residual", F.col(value) - F.col("trend"))


def exp_smoothing(df: DataFrame, keys: list[str], weight: float, initial: float,
                  order: str = "bin_idx", value: str = "value") -> DataFrame:
    """Weights ``(1 - w) w^t`` on past values and ``w^(t+1)`` on a given initial state."""
    rule = Recurrence(np.array([[weight]]), np.array([1 - weight]), np.array([initial]))
    return linear_recurrence(df, keys, rule, order, value, "smooth")


def moving_average(df: DataFrame, keys: list[str], kernels: list[int], order: str = "bin_idx",
                   value: str = "value", width: int = SLICE) -> DataFrame:
    """Centred moving average with repeated edges (mean over the kernels) and the residual.

    A slice holds ``width`` positions and a halo of half the widest kernel on both sides. The first and last row of
    a series stand for the positions beyond the edges.
    """
    for kernel in kernels:
        if kernel < 1 or kernel % 2 == 0:
            raise ValueError(f"kernel must be odd; got {kernel}")
    halo = (max(kernels) - 1) // 2
    width = max(width, halo)
    rows = positions(df, keys, order, value)
    pos, last = F.col("_pos"), F.col("_len") - 1
    seen = rows.withColumn("_at", F.explode(F.sequence(
        F.when(pos == 0, F.lit(-halo).cast("long")).otherwise(pos), F.when(pos == last, last + halo).otherwise(pos))))
    block = lambda at: F.floor(at / width).cast("long")
    dealt = seen.withColumn("_block", F.explode(F.sequence(
        F.greatest(block(F.col("_at") - halo), F.lit(0).cast("long")), F.least(block(F.col("_at") + halo), block(last)))))
    along = Window.partitionBy(*keys, "_block").orderBy("_at")
    means = [F.avg(value).over(along.rowsBetween(-(k // 2), k // 2)) for k in kernels]
    trend = reduce(Column.__add__, means) / len(kernels)
    own = (F.col("_at") == pos) & (block(F.col("_at")) == F.col("_block"))
    return (dealt.withColumn("trend", trend).filter(own)
            .select(*keys, order, value, "trend", (F.col(value) - F.col("trend")).alias("residual")))


def _mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def normalise_windows(windows: DataFrame, subtract_last: bool = False, x: str = "x") -> DataFrame:
    """Per-window centre (mean or last value), population spread and normalised input."""
    col = F.col(x)
    centre = F.element_at(col, -1) if subtract_last else _mean(col)
    out = windows.withColumn("_mean", _mean(col)).withColumn("centre", centre)
    var = _mean(F.transform(col, lambda v: (v - F.col("_mean")) * (v - F.col("_mean"))))
    return (out.withColumn("spread", F.sqrt(var + EPS))
            .withColumn(f"{x}_norm", F.transform(col, lambda v: (v - F.col("centre")) / F.col("spread")))
            .drop("_mean"))


def denormalise(windows: DataFrame, col: str) -> DataFrame:
    """Inverse of :func:`normalise_windows` for an array of the same window."""
    return windows.withColumn(col, F.transform(
        col, lambda v: v * F.col("spread") + F.col("centre")))


def patches(windows: DataFrame, patch_len: int, stride: int, padding: int, x: str = "x") -> DataFrame:
    """Overlapping patches of each window; the right edge is padded with its last value."""
    padded = F.concat(F.col(x), F.array_repeat(F.element_at(x, -1), padding))
    count = F.floor((F.size(x) + padding - patch_len) / stride).cast("int")
    return windows.withColumn("_padded", padded).withColumn("patches", F.transform(
        F.sequence(F.lit(0), count), lambda i: F.slice("_padded", i * stride + 1, patch_len))
    ).drop("_padded")


def downsample(df: DataFrame, keys: list[str], factor: int, layers: int, method: str = "avg",
               order: str = "bin_idx", value: str = "value") -> DataFrame:
    """Average or maximum pooling by ``factor``, ``factor**2``, … (incomplete tails drop out).

    All layers come from one pass: pooling a pooled layer equals pooling the rows directly.
    """
    pool = {"avg": F.avg, "max": F.max}[method]
    levels = F.array(*[F.struct(F.lit(i).alias("layer"), F.lit(factor ** i).alias("width"))
                       for i in range(1, layers + 1)])
    rows = (positions(df, keys, order, value).withColumn("_l", F.explode(levels))
            .withColumn("layer", F.col("_l.layer"))
            .withColumn("pooled_idx", F.floor(F.col("_pos") / F.col("_l.width"))))
    return (rows.groupBy(*keys, "layer", "_l.width", "pooled_idx")
            .agg(F.count("*").alias("_n"), pool(value).alias(value))
            .filter(F.col("_n") == F.col("width")).drop("_n", "width"))
