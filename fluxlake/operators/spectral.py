"""Dominant periods, season/trend split and harmonic extrapolation of gap-free series.

The spectrum of a series of any length is a transform in four steps. Positions are laid out as a matrix of
``n1`` rows and ``n2`` columns: tasks transform columns, turn the results by the twiddle factors and pass them on in
tiles (one row of binary data each), and tasks transform the rows. A length without two factors up to ``ROW``
is turned by a chirp into a convolution of a power of two (Bluestein): the transform of the series times that of the
chirp, transformed back, whose columns are transformed in the tasks that end the transform before. A group holds
about ``TASK`` values, or one row or column of the matrix, which is about as long as the root of the
series. The rows of a series are shuffled once, after that tiles.

The strongest frequencies are picked in each task first, then among the tasks' picks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxlake.operators.series import positions

ROW, TASK = 1 << 16, 1 << 18
SHAPE = {"n": T.LongType(), "_size": T.LongType(), "_n1": T.LongType(), "_n2": T.LongType(),
         "_cols": T.LongType(), "_rows": T.LongType(), "_chirp": T.BooleanType()}


def _shapes(rows: DataFrame, row: int, task: int) -> DataFrame:
    """A row per length: the size of the transform, its matrix, and the columns and rows that make up a group."""
    n = F.col("_len")
    factor = F.array_max(F.filter(F.sequence(F.lit(1).cast("long"), F.least(n, F.lit(row).cast("long"))), lambda d: n % d == 0))
    room = F.ceil(F.log2((2 * n - 1).cast("double")))
    two = lambda power: F.pow(F.lit(2.0), power).cast("long")
    out = rows.select("_len").distinct().withColumn("_factor", factor)
    out = out.withColumn("_chirp", F.expr(f"_len div _factor > {row}"))
    out = out.select(n.alias("n"), "_chirp", F.when(F.col("_chirp"), two(room)).otherwise(n).alias("_size"),
                     F.when(F.col("_chirp"), two(F.ceil(room / 2))).otherwise(F.col("_factor")).alias("_n2"))
    out = out.withColumn("_n1", F.expr("_size div _n2"))
    return out.withColumns({"_cols": F.expr(f"greatest(1L, {task} div _n1)"), "_rows": F.expr(f"greatest(1L, {task} div _n2)")})


def _chirp(at: np.ndarray, n: int) -> np.ndarray:
    """``exp(-i pi at^2 / n)``; the square is reduced before it becomes a float."""
    return np.exp(-1j * math.pi / n * (at * at % (2 * n)))


def _turned(matrix: np.ndarray, rows: np.ndarray, cols: np.ndarray, size: int) -> np.ndarray:
    """Times the twiddle factors of the transform of ``size``."""
    return matrix * np.exp(-2j * math.pi / size * (np.multiply.outer(rows, cols) % size))


def _tiles(group: pa.Table, keys: list[str], matrices: list[np.ndarray], height: int, col: int) -> pa.Table:
    """The matrices of a column block in tiles of ``height`` rows, one row of the table for each."""
    data = [np.stack([m[low: low + height] for m in matrices]).tobytes() for low in range(0, len(matrices[0]), height)]
    return pa.table({**{c: pa.repeat(group[c][0], len(data)) for c in (*keys, *SHAPE)},
                     "_block": pa.array(np.arange(len(data), dtype=np.int64)), "_col": pa.array(np.full(len(data), col, np.int64)),
                     "tile": pa.array(data, pa.binary())})


def _untiled(group: pa.Table, parts: int, n_cols: int, width: int) -> np.ndarray:
    """The matrices of a row block, from its tiles of ``width`` columns."""
    out = None
    for col, tile in zip(group["_col"].to_pylist(), group["tile"], strict=True):
        own = slice(col * width, min((col + 1) * width, n_cols))
        piece = np.frombuffer(tile.as_buffer(), np.complex128).reshape(parts, -1, own.stop - own.start)
        if out is None:
            out = np.empty((parts, piece.shape[1], n_cols), np.complex128)
        out[:, :, own] = piece
    return out


def _shape(group: pa.Table) -> tuple:
    return tuple(group[c][0].as_py() for c in SHAPE)


def _columns(group: pa.Table, keys: list[str], value: str) -> pa.Table:
    """From values to the transformed columns of a block; with a chirp, those of the chirp as well."""
    n, size, n1, n2, cols, rows, chirp = _shape(group)
    block = group["_block"][0].as_py()
    col = np.arange(block * cols, min((block + 1) * cols, n2))
    pos, v = group["_pos"].to_numpy(), group[value].to_numpy()
    matrix = np.zeros((n1, len(col)), np.complex128)
    matrix[pos // n2, pos % n2 - col[0]] = v * _chirp(pos, n) if chirp else v
    matrices = [matrix]
    if chirp:
        at = np.arange(n1)[:, None] * n2 + col
        near = np.minimum(at, size - at)
        matrices.append(np.where(near < n, np.conj(_chirp(np.minimum(near, n), n)), 0))
    done = [_turned(np.fft.fft(m, axis=0), np.arange(n1), col, size) for m in matrices]
    return _tiles(group, keys, done, rows, block)


def _product(group: pa.Table, keys: list[str]) -> pa.Table:
    """Ends the transforms of series and chirp on a block of rows, and begins the one back from their product."""
    n, size, n1, n2, cols, rows, _ = _shape(group)
    block = group["_block"][0].as_py()
    ours, chirps = np.fft.fft(_untiled(group, 2, n2, cols), axis=2)
    back = np.fft.fft(np.conj(ours * chirps), axis=1)
    row = np.arange(block * rows, block * rows + len(back))
    return _tiles(group, keys, [_turned(back.T, np.arange(n2), row, size)], cols, block)


def _waves(group: pa.Table, keys: list[str], k: int | None, inner: bool) -> pa.Table:
    """Coefficients of a block of rows up to half the length; the ``k`` strongest if that is given."""
    n, size, n1, n2, cols, rows, chirp = _shape(group)
    block = group["_block"][0].as_py()
    # the transform back has the matrix turned over
    length, height, step = (n1, cols, n2) if chirp else (n2, rows, n1)
    matrix = np.fft.fft(_untiled(group, 1, length, rows if chirp else cols)[0], axis=1)
    at = (block * height + np.arange(len(matrix)))[:, None] + step * np.arange(length)
    used = (at > 0) & (2 * at < n) if inner else 2 * at <= n
    f, x = at[used], matrix[used]
    if chirp:
        x = np.conj(x) / size * _chirp(f, n)
    if k is not None:
        strength = np.where(f > 0, np.abs(x), 0)
        best = np.lexsort((f, -strength))[:k]
        f, x = f[best], x[best]
    return pa.table({**{c: pa.repeat(group[c][0], len(f)) for c in keys}, "n": pa.array(np.full(len(f), n)),
                     "frequency": pa.array(f), "re": pa.array(x.real), "im": pa.array(x.imag)})


def spectrum(df: DataFrame, keys: list[str], order: str = "bin_idx", value: str = "value", k: int | None = None,
             inner: bool = False, row: int = ROW, task: int = TASK) -> DataFrame:
    """``keys, n, frequency, re, im, amplitude`` for all frequencies up to half the length; the mean's
    amplitude is 0.

    With ``inner`` the mean and the highest frequency of an even length are left out. With ``k`` a series has at
    least its ``k`` strongest.
    """
    rows = positions(df, keys, order, value)
    shapes = _shapes(rows, row, task)
    laid = rows.join(shapes, F.col("_len") == F.col("n")).select(
        *keys, *SHAPE, F.expr("_pos % _n2 div _cols").alias("_block"), "_pos", value)
    own = [f for f in laid.schema.fields if f.name in keys]
    passed = T.StructType([*own, *[T.StructField(*f) for f in SHAPE.items()], T.StructField("_block", T.LongType()),
                           T.StructField("_col", T.LongType()), T.StructField("tile", T.BinaryType())])
    found = T.StructType([*own, *[T.StructField(c, t) for c, t in (
        ("n", T.LongType()), ("frequency", T.LongType()), ("re", T.DoubleType()), ("im", T.DoubleType()))]])

    def columns(group: pa.Table) -> pa.Table:
        return _columns(group, keys, value)

    def product(group: pa.Table) -> pa.Table:
        return _product(group, keys)

    def coefficients(group: pa.Table) -> pa.Table:
        return _waves(group, keys, k, inner)

    tiles = laid.groupBy(*keys, "_block").applyInArrow(columns, passed)
    back = tiles.filter("_chirp").groupBy(*keys, "_block").applyInArrow(product, passed)
    waves = tiles.filter("NOT _chirp").unionAll(back).groupBy(*keys, "_block").applyInArrow(coefficients, found)
    size = F.when(F.col("frequency") == 0, 0.0).otherwise(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))
    return waves.withColumn("amplitude", size)


def _strongest(waves: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` largest amplitudes per key, from the tasks' picks; equal ones by frequency."""
    order = Window.partitionBy(*keys).orderBy(F.desc("amplitude"), "frequency")
    return waves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _gathered(waves: DataFrame, keys: list[str]) -> DataFrame:
    """At most k coefficients of a key in one row."""
    return waves.groupBy(*keys).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("frequency", "re", "im"))).alias("waves"))


def _sum_of(at: Column, n: Column) -> Column:
    """The harmonics at a position; a wave and its mirror image count twice, the highest of an even length once."""
    def add(total: Column, w: Column) -> Column:
        angle = F.lit(2 * math.pi) * F.pmod(w["frequency"] * at, n) / n
        times = F.when(2 * w["frequency"] == n, 1.0).otherwise(2.0)
        return total + times / n * (w["re"] * F.cos(angle) - w["im"] * F.sin(angle))
    return F.aggregate("waves", F.lit(0.0), add)


def dominant_periods(df: DataFrame, keys: list[str], k: int, order: str = "bin_idx",
                     value: str = "value") -> DataFrame:
    """The ``k`` strongest frequencies (mean left out): rank, frequency, amplitude, period."""
    period = F.when(F.col("frequency") > 0, F.expr("n div greatest(frequency, 1)")).otherwise(0)
    return _strongest(spectrum(df, keys, order, value, k), keys, k).select(
        *keys, "rank", "frequency", "amplitude", period.cast("long").alias("period"))


def season_trend(df: DataFrame, keys: list[str], k: int = 5, order: str = "bin_idx",
                 value: str = "value") -> DataFrame:
    """Season = the frequencies stronger than the ``k``-th strongest; trend = the rest."""
    top = _strongest(spectrum(df, keys, order, value, k), keys, k)
    floor = F.min("amplitude").over(Window.partitionBy(*keys))
    above = top.withColumn("_floor", floor).withColumn("_above", F.col("amplitude") > F.col("_floor"))
    waves = _gathered(above.filter("_above"), keys)
    rows = positions(df, keys, order, value).join(waves, keys, "left")
    season = F.coalesce(_sum_of(F.col("_pos"), F.col("n")), F.lit(0.0))
    return rows.withColumn("season", season).select(*keys, order, value, "season", (F.col(value) - F.col("season")).alias("trend"))


def harmonic_extrapolation(df: DataFrame, keys: list[str], k: int, pred_len: int,
                           order: str = "bin_idx", value: str = "value") -> DataFrame:
    """Sum of the ``k`` strongest harmonics evaluated over the series and ``pred_len`` steps on.

    The mean and, for an even length, the highest frequency take no part.
    """
    waves = _gathered(_strongest(spectrum(df, keys, order, value, k, inner=True), keys, k), keys)
    # a step of the series for each of its rows, and the last row has those after it as well
    rows = positions(df, keys, order, value).join(waves, keys)
    last = F.when(F.col("_pos") == F.col("_len") - 1, F.col("_pos") + pred_len).otherwise(F.col("_pos"))
    steps = rows.select(*keys, "n", "waves", F.explode(F.sequence("_pos", last)).alias("step"))
    return steps.select(*keys, "step", _sum_of(F.col("step"), F.col("n")).alias("fitted"))
