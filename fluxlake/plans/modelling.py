"""Queries on series decompositions, forecasters, losses and custom metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlake.functions import physics, scores
from fluxlake.functions.losses import LOSSES
from fluxlake.functions.metrics import STANDARD
from fluxlake.functions.registry import RUN_KEYS
from fluxlake.operators import forecast, grid, intervals, series, spectral, terms, windows
from fluxlake.operators.evaluate import by_channel, evaluate, to_long
from fluxlake.plans.common import (
    EVENT_OBS, ORDER_OBS, bins_sql, event_obs, order_obs, r, rnd, rounded, stamp, table, ts,
)
from fluxlake.plans.runs import (
    DAY_MIN, N_FOLD, ORDER_MASTERS_SQL, ORDER_PRED_SQL, RUN, THRESHOLDS, case_of, order_bins,
    order_predictions,
)

WEEK = 604_800
ALPHA, BETA, V0 = 0.3, 0.3, 5.25


def _weekly(spark: SparkSession, d: str) -> DataFrame:
    """Weekly means per order status: a gap-free series of a few hundred points."""
    week = F.floor(F.unix_seconds("time_utc") / WEEK).cast("long")
    return (order_obs(spark, d).groupBy("series", week.alias("bin_idx"))
            .agg(F.log10(F.avg("value")).alias("value")))


def _hourly_windows(spark: SparkSession, d: str) -> DataFrame:
    bins = (grid.bin_mean(event_obs(spark, d), 60, transform="log10")
            .filter(F.col("value").isNotNull()).withColumn("term", terms.term_label("bin_ts")))
    return windows.window_arrays(bins, 6, 3)


def ema(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.ema(_weekly(spark, d), ["series"], ALPHA), ["value", "trend", "residual"])


def double_ema(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.double_ema(_weekly(spark, d), ["series"], ALPHA, BETA),
                   ["value", "trend", "residual"])


def exp_smoothing(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.exp_smoothing(_weekly(spark, d), ["series"], 0.6, V0),
                   ["value", "smooth"])


def moving_avg_decomp(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.moving_average(_weekly(spark, d), ["series"], [5, 25]),
                   ["value", "trend", "residual"])


def _exploded(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    return df.select("series", "bin_idx", *keep, F.posexplode(col).alias("pos", "value"))


def instance_norm(spark: SparkSession, d: str) -> DataFrame:
    w = series.normalise_windows(_hourly_windows(spark, d))
    back = series.denormalise(w.withColumn("back", F.col("x_norm")), "back")
    return rounded(back.select("series", "bin_idx", "centre", "spread", F.posexplode(
        F.arrays_zip("x_norm", "back")).alias("pos", "_v")).select(
        "series", "bin_idx", "centre", "spread", "pos", F.col("_v.x_norm").alias("norm"),
        F.col("_v.back").alias("back")), ["centre", "spread", "norm", "back"])


def patching(spark: SparkSession, d: str) -> DataFrame:
    w = series.patches(_hourly_windows(spark, d), 3, 2, 2)
    p = w.select("series", "bin_idx", F.posexplode("patches").alias("patch", "p"))
    return rounded(p.select("series", "bin_idx", "patch", F.posexplode("p").alias("pos", "value")),
                   ["value"])


def downsample(spark: SparkSession, d: str) -> DataFrame:
    avg = series.downsample(_weekly(spark, d), ["series"], 4, 2, "avg")
    top = series.downsample(_weekly(spark, d), ["series"], 4, 2, "max")
    both = avg.withColumn("method", F.lit("avg")).unionByName(top.withColumn("method", F.lit("max")))
    return rounded(both, ["value"])


def dft_periods(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spectral.dominant_periods(_weekly(spark, d), ["series"], 3), ["amplitude"])


def dft_season_trend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spectral.season_trend(_weekly(spark, d), ["series"], 5),
                   ["value", "season", "trend"])


def harmonic_extrapolation(spark: SparkSession, d: str) -> DataFrame:
    out = spectral.harmonic_extrapolation(_weekly(spark, d), ["series"], 4, 26)
    return rounded(out, ["fitted"])


def persistence(spark: SparkSession, d: str) -> DataFrame:
    long = to_long(order_predictions(spark, d).filter(F.col("model") != "level"))
    return rounded(long.withColumn("forecast_start", stamp("forecast_start")), ["pred", "true"], 4)


def occurrence_persistence(spark: SparkSession, d: str) -> DataFrame:
    """Event in the preceding window of equal length against the event in the window."""
    level = by_channel(THRESHOLDS, "float", "log10")
    p = order_predictions(spark, d).filter(F.col("model") == "repeat")
    flag = lambda c: (F.array_max(c) >= level).cast("int")
    return p.select("track", "seq_len", "pred_len", "fold", "channel",
                    stamp("forecast_start").alias("forecast_start"),
                    flag("pred").alias("predicted"), flag("true").alias("observed"))


def _fold_bins(spark: SparkSession, d: str) -> DataFrame:
    return order_bins(spark, d).withColumn("fold", terms.test_fold_of("term_idx", N_FOLD))


def linear_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the direct linear forecaster per fold (two inputs, two steps ahead)."""
    bins = order_bins(spark, d)
    model = forecast.LinearModel(2, 2)
    weights = forecast.fit_folds(bins, bins.select("term", "term_idx").distinct(), model, N_FOLD)
    rows = [(f, lead, j, float(w[j, lead])) for f, w in weights.items()
            for lead in range(2) for j in range(3)]
    return rounded(spark.createDataFrame(rows, "fold int, lead int, feature int, weight double"),
                   ["weight"])


def _forecasts(spark: SparkSession, d: str, name: str, seq_len: int, strategy: str = "direct"):
    bins = _fold_bins(spark, d)
    term_ids = bins.select("term", "term_idx").distinct()
    return forecast.model_predictions(bins, term_ids, name, seq_len, 2, DAY_MIN, N_FOLD, strategy)


def _scored(pred: DataFrame) -> DataFrame:
    rows = evaluate(pred, None, metrics=["rmse", "mae", "logr"]).regression
    return rounded(rows.select(*RUN_KEYS, "channel", "n", "rmse", "mae", "logr"),
                   ["rmse", "mae", "logr"], 5)


def linear_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Direct, window-normalised linear forecaster, scored on the test terms of each fold."""
    return _scored(_forecasts(spark, d, "rlinear", 3))


def decomposition_forecast(spark: SparkSession, d: str) -> DataFrame:
    return _scored(_forecasts(spark, d, "dlinear", 3))


def recursive_forecast(spark: SparkSession, d: str) -> DataFrame:
    return _scored(_forecasts(spark, d, "linear", 3, "recursive"))


def ar_forecast(spark: SparkSession, d: str) -> DataFrame:
    return _ar(spark, d, 5, lags=1)


def ar_two_lags(spark: SparkSession, d: str) -> DataFrame:
    return _ar(spark, d, 8, lags=2)


def _ar(spark: SparkSession, d: str, seq_len: int, lags: int) -> DataFrame:
    """An autoregression fitted to every window, two steps ahead."""
    p = forecast.stat_predictions(_fold_bins(spark, d), "ar", seq_len, 2, DAY_MIN, lags=lags)
    return rounded(p.select("track", "channel", "fold", stamp("forecast_start").alias("forecast_start"),
                            F.posexplode("pred").alias("lead", "pred")), ["pred"])


def losses(spark: SparkSession, d: str) -> DataFrame:
    long = to_long(order_predictions(spark, d))
    p, t = F.col("pred").cast("double"), F.col("true").cast("double")
    return rounded(long.groupBy(*RUN_KEYS, "channel").agg(*[LOSSES[n](p, t).alias(n) for n in LOSSES]),
                   list(LOSSES))


def custom_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A score and a regression metric that the caller brings along get their own columns."""
    def gss(tp, fp, fn, tn):
        chance = scores.ratio((tp + fp) * (tp + fn), tp + fp + fn + tn)
        return scores.ratio(tp - chance, tp + fp + fn - chance)

    own = STANDARD.with_event("gss", gss, larger_is_better=True).with_regression(
        "maxerr", lambda pred, true: F.max(F.abs(pred - true)), space="stored")
    ev = evaluate(order_predictions(spark, d), THRESHOLDS, metrics=["gss", "maxerr"], units=["window"], known=own)
    gss_rows = ev.event.select(*RUN_KEYS, "channel", "gss")
    out = gss_rows.join(ev.regression.select(*RUN_KEYS, "channel", "maxerr"), [*RUN_KEYS, "channel"])
    return rounded(out, ["gss", "maxerr"])


def scalar_checks(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds in stored space, UTC parsing, time units and derived physical quantities."""
    o = table(spark, d, "orders", ["o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice"])
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(F.col("o_orderstatus") == "F", "Z").otherwise("+01:00"))
    price = F.col("o_totalprice")
    flux = F.array(price / 1e3, price / 1e4, price / 1e5)
    lo, hi = (F.array(*[F.lit(float(v)) for v in vs]) for vs in ((1, 5, 20), (5, 20, 80)))
    return rounded(o.select(
        "o_orderkey", stamp(intervals.parse_utc(text)).alias("parsed_utc"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("time_us"),
        (F.log10(price).cast("float") >= grid.stored_value(F.lit(250_000.0), "log10").cast("float"))
        .cast("int").alias("is_event"),
        physics.integral_flux(flux, lo, hi, 10.0).alias("flux_gt10"),
        physics.electric_field(price / 1000, F.lit(-4.5)).alias("e_field"),
        physics.dynamic_pressure(price / 1e5, price / 1000).alias("pressure"),
        physics.mach_number(price / 1000, price / 1e5, F.lit(-6.0)).alias("mach"),
    ), ["flux_gt10", "e_field", "pressure", "mach"], 9)


# ---- SQL counterparts -------------------------------------------------------------------------

_WK = (f"wk AS (SELECT series, CAST(floor(epoch(t) / {WEEK}) AS BIGINT) AS bin_idx, log10(avg(v)) AS value "
       f"FROM ({ORDER_OBS}) GROUP BY 1, 2), "
       "wp AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series ORDER BY bin_idx) - 1 AS pos, "
       "count(*) OVER (PARTITION BY series) AS n FROM wk)")
_WIN = f"""hb AS (SELECT series, idx, value FROM ({bins_sql(EVENT_OBS, 60, 'log10')}) WHERE value IS NOT NULL),
    st AS (SELECT series, idx, count(*) OVER (PARTITION BY series ORDER BY idx RANGE BETWEEN CURRENT ROW AND 8 FOLLOWING) AS k
           FROM hb),
    wx AS (SELECT st.series, st.idx AS bin_idx, CAST(hb.idx - st.idx AS INTEGER) AS pos, hb.value FROM st JOIN hb ON hb.series = st.series
           AND hb.idx BETWEEN st.idx AND st.idx + 5 WHERE k = 9)"""


def _recur(first: str, step: str) -> str:
    return (f"WITH RECURSIVE {_WK}, rc AS (SELECT series, pos, bin_idx, value, {first} FROM wp WHERE pos = 0 UNION ALL "
            f"SELECT w.series, w.pos, w.bin_idx, w.value, {step} FROM rc JOIN wp w ON w.series = rc.series AND w.pos = rc.pos + 1)")


def _ma(k: int) -> str:
    h = (k - 1) // 2
    return (f"(sum(value) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) "
            f"+ greatest(0, {h} - pos) * first_value(value) OVER (PARTITION BY series ORDER BY pos) "
            f"+ greatest(0, {h} - (n - 1 - pos)) * last_value(value) OVER (PARTITION BY series ORDER BY pos "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / {k}")


_DFT = f"""{_WK}, fr AS (SELECT DISTINCT series, n, unnest(range(0, n // 2 + 1)) AS f FROM wp),
    sp AS MATERIALIZED (SELECT series, wp.n, f, sum(value * cos(2 * pi() * f * pos / wp.n)) AS re,
      -sum(value * sin(2 * pi() * f * pos / wp.n)) AS im FROM wp JOIN fr USING (series) GROUP BY 1, 2, 3),
    am AS MATERIALIZED (SELECT *, CASE WHEN f = 0 THEN 0 ELSE sqrt(re * re + im * im) END AS amp FROM sp)"""
_LIN = f"""WITH {ORDER_PRED_SQL}, tbk2 AS MATERIALIZED (SELECT *, concat_ws('|', track, channel, term, idx) AS k,
      concat_ws('|', track, channel, term, idx + 1) AS k1, concat_ws('|', track, channel, term, idx + 2) AS k2,
      concat_ws('|', track, channel, term, idx + 3) AS k3 FROM tb),
    w2 AS MATERIALIZED (SELECT a.term, a.value AS x0, b.value AS x1, c.value AS y0, e.value AS y1
      FROM tbk2 a JOIN tbk2 b ON b.k = a.k1 JOIN tbk2 c ON c.k = a.k2 JOIN tbk2 e ON e.k = a.k3),
    tr AS (SELECT fold, x0, x1, l.lead, CASE l.lead WHEN 0 THEN y0 ELSE y1 END AS y FROM w2 JOIN terms USING (term),
      (SELECT CAST(unnest(range({N_FOLD})) AS INTEGER) AS fold) f, (VALUES (0), (1)) l(lead)
      WHERE ((term_idx - fold) % {N_FOLD} + {N_FOLD}) % {N_FOLD} < {N_FOLD - 2}),
    cv AS (SELECT fold, lead, var_pop(x0) AS a, var_pop(x1) AS b, covar_pop(x0, x1) AS c, covar_pop(x0, y) AS u,
      covar_pop(x1, y) AS v, avg(x0) AS m0, avg(x1) AS m1, avg(y) AS my FROM tr GROUP BY 1, 2),
    wt AS (SELECT fold, lead, (b*u - c*v) / (a*b - c*c) AS w0, (a*v - c*u) / (a*b - c*c) AS w1, m0, m1, my FROM cv)
    """


_WINDOW = "track, channel, term, term_idx, s"
_FOLD = f"CAST((term_idx + 1) % {N_FOLD} AS INTEGER) AS fold"


def _windows_sql(length: int) -> str:
    """Gap-free windows of the binned order tracks: ``i`` holds the values from bin ``s`` on."""
    return f"""{ORDER_PRED_SQL}, wn AS (SELECT track, channel, term, term_idx, idx AS s, i FROM (
        SELECT *, list(value) OVER w AS i, max(idx) OVER w AS upto FROM tb
        WINDOW w AS (PARTITION BY track, channel, term ORDER BY idx ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING))
        WHERE len(i) = {length} AND upto = idx + {length - 1})"""


def _starts(seq_len: int) -> str:
    return ts(f"make_timestamp((s + {seq_len}) * 86400000000)", "forecast_start")


def _det(m: list[list[str]]) -> str:
    """Determinant, written out."""
    if len(m) == 1:
        return m[0][0]
    minors = [[row[:j] + row[j + 1:] for row in m[1:]] for j in range(len(m))]
    return "(" + " ".join(f"{'-' if j % 2 else '+'} {m[0][j]} * {_det(minors[j])}" for j in range(len(m))) + ")"


def _least_squares_sql(model: str, strategy: str, features: list[str], penalty: list[list[float]],
                       centre: str = "0", spread: str = "1") -> str:
    """Scores of a linear forecaster of three inputs and two steps: normal equations per fold, Cramer's rule."""
    names = ["1.0", *features]
    n, ahead = len(names), 1 if strategy == "recursive" else 2
    along = "OVER (PARTITION BY track, channel, term ORDER BY idx)"
    lead = lambda k, c="value": f"lead({c}, {k}) {along}"
    window = lambda steps: (
        f"SELECT *, {centre} AS mu, {spread} AS sg FROM (SELECT track, channel, term, term_idx, value AS x0, {lead(1)} AS x1, "
        f"{lead(2)} AS x2, {lead(3)} AS y0, {lead(4)} AS y1, {lead(2 + steps, 'idx')} - idx AS gap FROM tb) WHERE gap = {2 + steps}")
    sums = ", ".join(f"sum(f{i} * f{j}) + {penalty[i][j]!r} AS s{i}{j}" for i in range(n) for j in range(n))
    right = ", ".join(f"sum(f{i} * y) AS b{i}" for i in range(n))
    matrix = [[f"s{i}{j}" for j in range(n)] for i in range(n)]
    swapped = [[[f"b{i}" if j == k else f"s{i}{j}" for j in range(n)] for i in range(n)] for k in range(n)]
    weights = ", ".join(f"{_det(swapped[k])} / {_det(matrix)} AS w{k}" for k in range(n))
    value = " + ".join(f"w{k} * ({e})" for k, e in enumerate(names))
    if strategy == "recursive":
        again = f"w0 + w1 * x1 + w2 * x2 + w3 * ({value})"
        steps = f"SELECT *, 0 AS l, {value} AS p, y0 AS y FROM q UNION ALL SELECT *, 1, {again}, y1 FROM q"
    else:
        steps = f"SELECT *, lead AS l, mu + sg * ({value}) AS p, CASE lead WHEN 0 THEN y0 ELSE y1 END AS y FROM q"
    return f"""WITH {ORDER_PRED_SQL},
    tw AS MATERIALIZED ({window(ahead)}),
    tr AS (SELECT CAST(f.fold AS INTEGER) AS fold, l.lead, {", ".join(f"{e} AS f{i}" for i, e in enumerate(names))},
      (CASE l.lead WHEN 0 THEN y0 ELSE y1 END - mu) / sg AS y FROM tw, (SELECT unnest(range({N_FOLD})) AS fold) f,
      (SELECT unnest(range({ahead})) AS lead) l WHERE ((term_idx - f.fold) % {N_FOLD} + {N_FOLD}) % {N_FOLD} < {N_FOLD - 2}),
    sm AS (SELECT fold, lead, {sums}, {right} FROM tr GROUP BY 1, 2),
    wt AS MATERIALIZED (SELECT fold, lead, {weights} FROM sm),
    w AS (SELECT *, CAST((term_idx + 1) % {N_FOLD} AS INTEGER) AS fold FROM ({window(2)})),
    q AS (SELECT w.*, wt.lead, {", ".join(f"w{k}" for k in range(n))} FROM w JOIN wt ON wt.fold = w.fold),
    made AS (SELECT track, channel, fold, CAST(p AS REAL) AS p, CAST(y AS REAL) AS y FROM ({steps}))
    SELECT track, 3 AS seq_len, 2 AS pred_len, fold, '{strategy}' AS strategy, '{model}' AS model, channel, count(*) AS n,
      {r('sqrt(avg((p::DOUBLE-y)*(p::DOUBLE-y)))', 'rmse', 5)}, {r('avg(abs(p::DOUBLE-y))', 'mae', 5)},
      {r('CASE WHEN min(p) < max(p) AND min(y) < max(y) THEN corr(p::DOUBLE, y::DOUBLE) END', 'logr', 5)}
    FROM made GROUP BY track, fold, channel"""


def _ridge(size: float, inner: np.ndarray) -> list[list[float]]:
    """Penalty matrix: ``size`` on the constant and on the quadratic form ``inner`` of the other weights."""
    out = np.zeros((len(inner) + 1, len(inner) + 1))
    out[0, 0], out[1:, 1:] = size, size * inner
    return out.tolist()


# Normalised inputs add up to zero, so two coordinates in that plane carry them, lengths unchanged.
_MU = "(x0 + x1 + x2) / 3"
_SG = f"sqrt((x0*x0 + x1*x1 + x2*x2) / 3 - ({_MU}) * ({_MU}) + 1e-5)"
_PLANE = ["(x0 - x1) / sg / sqrt(2.0)", "(x0 + x1 - 2 * x2) / sg / sqrt(6.0)"]
# A moving mean of 25 over three values with repeated edges; weights of trend and rest are penalised
# alike, which for the weights of the inputs themselves is a quadratic form.
_TREND = np.array([[13 - i, 1, 11 + i] for i in range(3)]) / 25
_REST = np.eye(3) - _TREND
_FORM = np.linalg.inv(_REST.T @ _REST + _TREND.T @ _TREND)
_INPUTS = ["x0", "x1", "x2"]

QUERIES = {
    "ema": (ema, _recur("value AS trend", f"{ALPHA} * w.value + (1 - {ALPHA}) * trend")
            + f" SELECT series, bin_idx, {r('value', 'value')}, {r('trend', 'trend')}, {r('value - trend', 'residual')} FROM rc"),
    "double_ema": (double_ema, (
        f"WITH RECURSIVE {_WK}, rc AS (SELECT a.series, a.pos, a.bin_idx, a.value, a.value AS lv, b.value - a.value AS sl "
        "FROM wp a JOIN wp b ON a.series = b.series AND a.pos = 0 AND b.pos = 1 UNION ALL "
        "SELECT s.series, s.pos, s.bin_idx, s.value, s.nl, "
        f"{BETA} * (s.nl - s.lv) + (1 - {BETA}) * s.sl FROM (SELECT w.series, w.pos, w.bin_idx, w.value, rc.lv, rc.sl, "
        f"{ALPHA} * w.value + (1 - {ALPHA}) * (rc.lv + rc.sl) AS nl FROM rc JOIN wp w ON w.series = rc.series AND w.pos = rc.pos + 1) s) "
        f"SELECT series, bin_idx, {r('value', 'value')}, {r('lv', 'trend')}, {r('value - lv', 'residual')} FROM rc")),
    "exp_smoothing": (exp_smoothing, _recur(f"0.6 * {V0} + 0.4 * value AS sm", "0.6 * sm + 0.4 * w.value")
                      + f" SELECT series, bin_idx, {r('value', 'value')}, {r('sm', 'smooth')} FROM rc"),
    "moving_avg_decomp": (moving_avg_decomp, (
        f"WITH {_WK}, m AS (SELECT *, ({_ma(5)} + {_ma(25)}) / 2 AS trend FROM wp) SELECT series, bin_idx, "
        f"{r('value', 'value')}, {r('trend', 'trend')}, {r('value - trend', 'residual')} FROM m")),
    "instance_norm": (instance_norm, (
        f"WITH {_WIN}, s AS (SELECT series, bin_idx, avg(value) AS c, sqrt(var_pop(value) + 1e-5) AS sd FROM wx GROUP BY 1, 2) "
        f"SELECT series, bin_idx, {r('c', 'centre')}, {r('sd', 'spread')}, pos, {r('(value - c) / sd', 'norm')}, "
        f"{r('value', 'back')} FROM wx JOIN s USING (series, bin_idx)")),
    "patching": (patching, (
        f"WITH {_WIN}, g AS (SELECT series, bin_idx, CAST(patch AS INTEGER) AS patch, CAST(q AS INTEGER) AS q, "
        "CAST(least(5, patch * 2 + q) AS INTEGER) AS at FROM (SELECT DISTINCT series, bin_idx FROM wx), "
        "(SELECT unnest(range(3)) AS patch), (SELECT unnest(range(3)) AS q)) "
        f"SELECT series, bin_idx, patch, q AS pos, {r('wx.value', 'value')} FROM g JOIN wx USING (series, bin_idx) WHERE wx.pos = g.at")),
    "downsample": (downsample, " UNION ALL ".join(
        f"SELECT series, {i} AS layer, pos // {4 ** i} AS pooled_idx, {r(f'{fn}(value)', 'value')}, '{fn}' AS method "
        f"FROM wp GROUP BY 1, 3 HAVING count(*) = {4 ** i}" if (i, fn) != (1, "avg") else
        f"WITH {_WK} SELECT series, {i} AS layer, pos // {4 ** i} AS pooled_idx, {r(f'{fn}(value)', 'value')}, '{fn}' AS method "
        f"FROM wp GROUP BY 1, 3 HAVING count(*) = {4 ** i}" for i, fn in ((1, "avg"), (2, "avg"), (1, "max"), (2, "max")))),
    "dft_periods": (dft_periods, (
        f"WITH {_DFT} SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY amp DESC) AS INTEGER) AS rank, "
        f"f AS frequency, {r('amp', 'amplitude')}, n // f AS period FROM am WHERE f > 0 "
        "QUALIFY row_number() OVER (PARTITION BY series ORDER BY amp DESC) <= 3")),
    "dft_season_trend": (dft_season_trend, (
        f"WITH {_DFT}, top AS (SELECT * FROM am QUALIFY row_number() OVER (PARTITION BY series ORDER BY amp DESC) <= 4), "
        "se AS (SELECT wp.series, bin_idx, value, sum((CASE WHEN 2 * f = top.n THEN 1.0 ELSE 2.0 END) / top.n * "
        "(re * cos(2 * pi() * f * pos / top.n) - im * sin(2 * pi() * f * pos / top.n))) AS season FROM wp JOIN top USING (series) "
        f"GROUP BY 1, 2, 3) SELECT series, bin_idx, {r('value', 'value')}, {r('season', 'season')}, {r('value - season', 'trend')} FROM se")),
    "harmonic_extrapolation": (harmonic_extrapolation, (
        f"WITH {_DFT}, top AS (SELECT * FROM am WHERE f > 0 AND 2 * f < n QUALIFY row_number() OVER (PARTITION BY series ORDER BY amp DESC) <= 4), "
        "tt AS (SELECT *, unnest(range(0, n + 26)) AS step FROM top) SELECT series, step, "
        f"{r('sum(2.0 / n * (re * cos(2 * pi() * f * step / n) - im * sin(2 * pi() * f * step / n)))', 'fitted')} FROM tt GROUP BY 1, 2")),
    "persistence": (persistence, (
        f"WITH {ORDER_PRED_SQL} SELECT {RUN}, channel, {ts('make_timestamp(fs * 86400000000)', 'forecast_start')}, lead, "
        f"{r('p', 'pred', 4)}, {r('y', 'true', 4)} FROM pred WHERE model <> 'level'").replace("AS true", 'AS "true"')),
    "occurrence_persistence": (occurrence_persistence, (
        f"WITH {ORDER_PRED_SQL}, f AS (SELECT DISTINCT track, seq_len, pred_len, fold, channel, fs, term FROM pred JOIN "
        "(SELECT DISTINCT track, channel, term, idx FROM tb) q USING (track, channel) WHERE q.idx = fs), "
        f"t2 AS (SELECT track, channel, term, idx, CAST(value AS REAL) >= CAST({case_of(THRESHOLDS, 'log10({})')} AS REAL) AS e FROM tb) "
        f"SELECT f.track, seq_len, pred_len, fold, f.channel, {ts('make_timestamp(fs * 86400000000)', 'forecast_start')}, "
        "CAST(bool_or(CASE WHEN idx < fs THEN e ELSE false END) AS INTEGER) AS predicted, "
        "CAST(bool_or(CASE WHEN idx >= fs THEN e ELSE false END) AS INTEGER) AS observed "
        "FROM f JOIN (SELECT unnest(range(-3, 3)) AS o) o ON o.o >= -pred_len AND o.o < pred_len "
        "JOIN t2 ON t2.track = f.track AND t2.channel = f.channel AND t2.term = f.term AND t2.idx = fs + o.o GROUP BY ALL")),
    "linear_weights": (linear_weights, (
        f"{_LIN} SELECT fold, lead, 0 AS feature, {r('my - w0 * m0 - w1 * m1', 'weight')} FROM wt "
        f"UNION ALL SELECT fold, lead, 1, {r('w0')} FROM wt UNION ALL SELECT fold, lead, 2, {r('w1')} FROM wt")),
    "linear_forecast": (linear_forecast, _least_squares_sql("rlinear", "direct", _PLANE, _ridge(1e-3, np.eye(2)), _MU, _SG)),
    "decomposition_forecast": (decomposition_forecast, _least_squares_sql("dlinear", "direct", _INPUTS, _ridge(1e-3, _FORM))),
    "recursive_forecast": (recursive_forecast, _least_squares_sql("linear", "recursive", _INPUTS, _ridge(0.0, np.eye(3)))),
    "ar_forecast": (ar_forecast, (
        f"WITH {_windows_sql(7)}, "
        f"ft AS (SELECT {_WINDOW}, any_value(i) AS i, regr_slope(y, u) AS b, regr_intercept(y, u) AS a FROM "
        f"(SELECT {_WINDOW}, i, unnest(i[2:5]) AS y, unnest(i[1:4]) AS u FROM wn) GROUP BY {_WINDOW}), "
        "fc AS (SELECT *, a + b * i[5] AS f1 FROM ft) "
        f"SELECT track, channel, {_FOLD}, {_starts(5)}, h AS lead, {r('CASE h WHEN 0 THEN f1 ELSE a + b * f1 END', 'pred')} "
        "FROM fc, (VALUES (0), (1)) hh(h)")),
    "ar_two_lags": (ar_two_lags, (
        f"WITH {_windows_sql(10)}, cv AS (SELECT {_WINDOW}, any_value(i) AS i, var_pop(u) AS a, var_pop(v) AS b, covar_pop(u, v) AS c, "
        "covar_pop(u, y) AS p, covar_pop(v, y) AS q, avg(u) AS mu, avg(v) AS mv, avg(y) AS my FROM "
        f"(SELECT {_WINDOW}, i, unnest(i[3:8]) AS y, unnest(i[2:7]) AS u, unnest(i[1:6]) AS v FROM wn) GROUP BY {_WINDOW}), "
        "ft AS (SELECT *, (b * p - c * q) / (a * b - c * c) AS w1, (a * q - c * p) / (a * b - c * c) AS w2 FROM cv), "
        "fc AS (SELECT *, my + w1 * (i[8] - mu) + w2 * (i[7] - mv) AS f1 FROM ft) "
        f"SELECT track, channel, {_FOLD}, {_starts(8)}, h AS lead, "
        f"{r('CASE h WHEN 0 THEN f1 ELSE my + w1 * (f1 - mu) + w2 * (i[8] - mv) END', 'pred')} FROM fc, (VALUES (0), (1)) hh(h)")),
    "losses": (losses, (
        f"WITH {ORDER_PRED_SQL}, e AS (SELECT *, p::DOUBLE - y AS d FROM pred) SELECT {RUN}, channel, {r('avg(d*d)', 'mse')}, "
        f"{r('avg(abs(d))', 'mae')}, {r('avg(CASE WHEN abs(d) <= 1 THEN 0.5*d*d ELSE abs(d) - 0.5 END)', 'huber')}, "
        f"{r('avg((1 + greatest(y::DOUBLE, 0)) * d * d)', 'weighted_mse')} FROM e GROUP BY {RUN}, channel")),
    "custom_metrics": (custom_metrics, (
        f"WITH {ORDER_MASTERS_SQL}, mx AS (SELECT {RUN}, channel, max(abs(p::DOUBLE - y)) AS me FROM pred GROUP BY {RUN}, channel) "
        f"SELECT {RUN}, channel, {r('(tp - (tp+fp)*(tp+fn)*1.0/n) / nullif(tp+fp+fn - (tp+fp)*(tp+fn)*1.0/n, 0)', 'gss')}, "
        f"{r('me', 'maxerr')} FROM evt JOIN mx USING ({RUN}, channel) WHERE granularity = 'window'")),
    "scalar_checks": (scalar_checks, (
        f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS parsed_utc, "
        "epoch_us(o_orderdate) AS time_us, CAST(CAST(log10(o_totalprice) AS REAL) >= CAST(log10(250000.0) AS REAL) AS INTEGER) AS is_event, "
        f"{r('o_totalprice / 1e4 * 10 + o_totalprice / 1e5 * 60', 'flux_gt10', 9)}, {r('o_totalprice / 1000 * 4.5e-3', 'e_field', 9)}, "
        f"{r('2e-6 * o_totalprice / 1e5 * (o_totalprice / 1000) * (o_totalprice / 1000)', 'pressure', 9)}, "
        f"{r('o_totalprice / 1000 * sqrt(o_totalprice / 1e5) / 120', 'mach', 9)} FROM orders")),
}
