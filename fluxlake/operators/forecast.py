"""Linear forecasters fitted by distributed normal equations, and per-window fits.

A (series, term) stretch of a binned table is bounded by the grid, so one task can slide over it.
The normal equations are summed per term once, which serves every fold; only the sums, whose size
depends on the model and not on the data, reach the driver for the solve.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxlake.functions.registry import Shelf
from fluxlake.operators.grid import bin_time
from fluxlake.operators.terms import split_of

KEYS = ["track", "channel", "term"]
EPS = 1e-5
MOVING_KERNEL = 25
CHUNK = 4096


@dataclass(frozen=True)
class LinearModel:
    """A linear map from ``seq_len`` inputs to ``pred_len`` outputs.

    ``norm`` is None, ``"mean"`` or ``"last"`` (per-window normalisation and its inverse);
    ``decompose`` fits separate maps for the moving-average trend and the rest.
    """
    seq_len: int
    pred_len: int
    norm: str | None = None
    decompose: bool = False
    ridge: float = 0.0

    def scale(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.norm is None:
            return np.zeros((len(x), 1)), np.ones((len(x), 1))
        centre = x[:, -1:] if self.norm == "last" else x.mean(axis=1, keepdims=True)
        return centre, np.sqrt(x.var(axis=1, keepdims=True) + EPS)

    def features(self, x: np.ndarray) -> np.ndarray:
        if self.decompose:
            half = (MOVING_KERNEL - 1) // 2
            padded = np.concatenate([np.repeat(x[:, :1], half, 1), x, np.repeat(x[:, -1:], half, 1)], 1)
            trend = sliding_window_view(padded, MOVING_KERNEL, axis=1).mean(axis=-1)
            x = np.concatenate([x - trend, trend], axis=1)
        return np.concatenate([np.ones((len(x), 1)), x], axis=1)

    @property
    def n_features(self) -> int:
        return 1 + self.seq_len * (2 if self.decompose else 1)


def _window_chunks(table: pa.Table, seq_len: int, pred_len: int, chunk: int = CHUNK):
    """(start bins, inputs, targets) of the gap-free windows of one stretch, a bounded number at a time."""
    table = table.sort_by("bin_idx")
    idx, val = table["bin_idx"].to_numpy(), table["value"].to_numpy().astype(float)
    span = seq_len + pred_len
    if len(idx) < span:
        return
    whole = sliding_window_view(val, span)
    ok = idx[span - 1:] - idx[:len(idx) - span + 1] == span - 1
    for low in range(0, len(ok), chunk):
        own = ok[low: low + chunk]
        part = whole[low: low + chunk][own]
        yield idx[low: low + len(own)][own], part[:, :seq_len], part[:, seq_len:]


def term_sums(bins: DataFrame, model: LinearModel, keys: list[str] = KEYS) -> DataFrame:
    """Normal-equation sums per (track, channel, term): lines of ``[X'X | X'Y]`` as ``term, line, sums``."""
    kinds = {f.name: f.dataType for f in bins.schema.fields}
    schema = T.StructType([T.StructField("term", kinds["term"]), T.StructField("line", T.IntegerType()),
                           T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def run(group: pa.Table) -> pa.Table:
        n = model.n_features
        sums = np.zeros((n, n + model.pred_len))
        for _, x, y in _window_chunks(group, model.seq_len, model.pred_len):
            centre, spread = model.scale(x)
            z = model.features((x - centre) / spread)
            sums[:, :n] += z.T @ z
            sums[:, n:] += z.T @ ((y - centre) / spread)
        # one row per line of the matrix: no row is longer than a line
        return pa.table({"term": pa.repeat(group["term"][0], n), "line": pa.array(range(n), pa.int32()),
                         "sums": pa.array(sums.tolist(), pa.list_(pa.float64()))})

    return bins.select(*keys, "bin_idx", "value").groupBy(*keys).applyInArrow(run, schema)


def fit_folds(bins: DataFrame, terms: DataFrame, model: LinearModel, n_fold: int) -> dict[int, np.ndarray]:
    """Weights ``(n_features, pred_len)`` per fold from its training terms.

    ``terms`` has ``term, term_idx``. What is collected is ``n_fold`` matrices of model size.
    """
    n, p = model.n_features, model.pred_len
    sums = term_sums(bins, model).join(terms.select("term", "term_idx"), "term")
    trained = (
        sums.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_fold - 1))))
        .filter(split_of("term_idx", "fold", n_fold) == "train")
    )
    # lines of a fold are added place by place, and few rows carry them to the driver
    lines = (trained.select("fold", "line", F.posexplode("sums").alias("pos", "v"))
             .groupBy("fold", "line", "pos").agg(F.sum("v").alias("total"))
             .groupBy("fold", "line").agg(F.array_sort(F.collect_list(F.struct("pos", "total"))).alias("_v"))
             .select("fold", "line", F.col("_v.total").alias("totals")))
    matrices: dict[int, np.ndarray] = {}
    for row in lines.toLocalIterator():
        matrices.setdefault(row.fold, np.zeros((n, n + p)))[row.line] = row.totals
    return {fold: np.linalg.lstsq(m[:, :n] + model.ridge * np.eye(n), m[:, n:], rcond=None)[0]
            for fold, m in matrices.items()}


Predictor = Callable[[int, np.ndarray], np.ndarray]


def _predict(bins: DataFrame, seq_len: int, pred_len: int, cadence_min: int, name: str, strategy: str,
             predict: Predictor, fold_col: str, keys: list[str] = KEYS) -> DataFrame:
    """Prediction table (doubles) of ``predict(fold, inputs)`` over every gap-free window."""
    kinds = {f.name: f for f in bins.schema.fields}
    arr = T.ArrayType(T.DoubleType())
    schema = T.StructType([kinds[k] for k in keys] + [
        T.StructField("fold", T.IntegerType()), T.StructField("forecast_idx", T.LongType()),
        T.StructField("pred", arr), T.StructField("true", arr)])

    def run(group: pa.Table) -> pa.Table:
        fold = group[fold_col][0].as_py()
        starts, preds, trues = [], [], []
        for start, x, y in _window_chunks(group, seq_len, pred_len):
            starts.append(start + seq_len)
            preds.append(predict(fold, x) if len(x) else y)
            trues.append(y)
        size = sum(map(len, starts))
        same = {k: pa.repeat(group[k][0], size) for k in keys}
        flat = lambda parts: pa.array(np.concatenate([x.ravel() for x in parts]) if parts else [], pa.float64())
        ends = pa.array(np.arange(size + 1) * pred_len, pa.int32())
        return pa.table({**same, "fold": pa.array(np.full(size, fold), pa.int32()),
                         "forecast_idx": pa.array(np.concatenate(starts) if starts else [], pa.int64()),
                         "pred": pa.ListArray.from_arrays(ends, flat(preds)), "true": pa.ListArray.from_arrays(ends, flat(trues))})

    out = bins.select(*keys, fold_col, "bin_idx", "value").groupBy(*keys).applyInArrow(run, schema)
    return out.select(
        "track", F.lit(seq_len).alias("seq_len"), F.lit(pred_len).alias("pred_len"), "fold",
        F.lit(strategy).alias("strategy"), F.lit(name).alias("model"), "channel",
        bin_time("forecast_idx", cadence_min).alias("forecast_start"), "pred", "true")


def linear_predictions(bins: DataFrame, model: LinearModel, weights: dict[int, np.ndarray],
                       cadence_min: int, name: str, fold_col: str = "fold") -> DataFrame:
    """Direct multi-step forecasts; ``fold_col`` names the fold whose weights apply to a term."""
    def predict(fold, x):
        centre, spread = model.scale(x)
        return model.features((x - centre) / spread) @ weights[fold] * spread + centre
    return _predict(bins, model.seq_len, model.pred_len, cadence_min, name, "direct", predict, fold_col)


def recursive_predictions(bins: DataFrame, one_step: LinearModel, weights: dict[int, np.ndarray],
                          pred_len: int, cadence_min: int, name: str, fold_col: str = "fold") -> DataFrame:
    """A one-step model rolled forward, each forecast fed back as the newest input."""
    def predict(fold, x):
        steps = []
        for _ in range(pred_len):
            centre, spread = one_step.scale(x)
            step = one_step.features((x - centre) / spread) @ weights[fold] * spread + centre
            steps.append(step)
            x = np.concatenate([x[:, 1:], step], axis=1)
        return np.concatenate(steps, axis=1)
    return _predict(bins, one_step.seq_len, pred_len, cadence_min, name, "recursive", predict, fold_col)


# ---- model registry ---------------------------------------------------------------------------

# (seq_len, pred_len) -> LinearModel
MODELS = Shelf("model")


@MODELS.holding("rlinear")
def _rlinear(seq_len, pred_len):
    return LinearModel(seq_len, pred_len, norm="mean", ridge=1e-3)


@MODELS.holding("dlinear")
def _dlinear(seq_len, pred_len):
    return LinearModel(seq_len, pred_len, decompose=True, ridge=1e-3)


@MODELS.holding("linear")
def _linear(seq_len, pred_len):
    return LinearModel(seq_len, pred_len)


def model_predictions(bins: DataFrame, terms: DataFrame, name: str, seq_len: int, pred_len: int,
                      cadence_min: int, n_fold: int, strategy: str = "direct") -> DataFrame:
    """Fit a registered model on the training terms of every fold and predict the test terms.

    ``bins`` carries ``fold``, the fold that tests its term. ``recursive`` fits one step and rolls
    it forward.
    """
    model = MODELS[name](seq_len, 1 if strategy == "recursive" else pred_len)
    weights = fit_folds(bins, terms, model, n_fold)
    if strategy == "recursive":
        return recursive_predictions(bins, model, weights, pred_len, cadence_min, name)
    return linear_predictions(bins, model, weights, cadence_min, name)


# ---- per-window statistical fits --------------------------------------------------------------

# (histories (N, L), steps, **options) -> forecasts (N, steps)
STAT_MODELS = Shelf("statistical model")


def autoregression(histories: np.ndarray, steps: int, lags: int = 1) -> np.ndarray:
    """Least-squares AR(lags) with a constant, fitted to each history, all histories at once."""
    n, length = histories.shape
    cols = [np.ones((n, length - lags))]
    cols += [histories[:, lags - j:length - j] for j in range(1, lags + 1)]
    design = np.stack(cols, axis=-1)
    coef = np.einsum("nij,nj->ni", np.linalg.pinv(design), histories[:, lags:])
    past = histories[:, ::-1][:, :lags]
    out = []
    for _ in range(steps):
        step = coef[:, :1] + (coef[:, 1:] * past).sum(axis=1, keepdims=True)
        out.append(step)
        past = np.concatenate([step, past[:, :-1]], axis=1)
    return np.concatenate(out, axis=1)


STAT_MODELS.holding("ar")(autoregression)


def stat_predictions(bins: DataFrame, name: str, seq_len: int, pred_len: int, cadence_min: int,
                     fold_col: str = "fold", **options) -> DataFrame:
    """Fit a named model to every window; ``options`` go to the model (``lags`` of ``ar``). A failed
    or non-finite fit falls back to the last observed value."""
    fit = STAT_MODELS[name].fn

    def predict(fold, x):
        last = np.repeat(x[:, -1:], pred_len, axis=1)
        try:
            made = np.asarray(fit(x, pred_len, **options), dtype=float)
        except (ValueError, np.linalg.LinAlgError):
            return last
        if made.shape != last.shape:
            return last
        return np.where(np.isfinite(made).all(axis=1, keepdims=True), made, last)
    return _predict(bins, seq_len, pred_len, cadence_min, name, "statistic", predict, fold_col)
