from datetime import datetime, timedelta
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlake.functions.losses import LOSSES
from fluxlake.operators import forecast, series, spectral
from fluxlake.operators.baselines import baseline_predictions

RNG = np.random.default_rng(7)


def bins(spark, values, first=0, track="t", term="a", term_idx=0, gaps=()):
    rows = [(track, "c", term, term_idx, first + i, float(v)) for i, v in enumerate(values) if i not in gaps]
    return spark.createDataFrame(rows, "track string, channel string, term string, term_idx int, bin_idx long, value double")


def ordered(df, *cols):
    return [np.array([r[c] for r in df.orderBy("bin_idx").collect()]) for c in cols]


def test_smoothers_equal_plain_recurrences(spark):
    x = RNG.normal(size=60)
    b = bins(spark, x)
    s = [x[0]]
    for v in x[1:]:
        s.append(0.3 * v + 0.7 * s[-1])
    np.testing.assert_allclose(ordered(series.ema(b, ["track"], 0.3), "trend")[0], s)
    level, slope, out = x[0], x[1] - x[0], [x[0]]
    for v in x[1:]:
        new = 0.4 * v + 0.6 * (level + slope)
        slope = 0.2 * (new - level) + 0.8 * slope
        level = new
        out.append(level)
    np.testing.assert_allclose(ordered(series.double_ema(b, ["track"], 0.4, 0.2), "trend")[0], out)
    st, sm = 2.0, []
    for v in x:
        st = 0.6 * st + 0.4 * v
        sm.append(st)
    np.testing.assert_allclose(ordered(series.exp_smoothing(b, ["track"], 0.6, 2.0), "smooth")[0], sm)


def test_long_ema_keeps_precision(spark):
    x = RNG.normal(size=3000)
    s = x[0]
    for v in x[1:]:
        s = 0.3 * v + 0.7 * s
    assert ordered(series.ema(bins(spark, x), ["track"], 0.3), "trend")[0][-1] == pytest.approx(s, rel=1e-12)


@pytest.mark.parametrize("kernel", [1, 5, 25])
def test_moving_average_equals_padding_and_convolution(spark, kernel):
    x = RNG.normal(size=40)
    half = (kernel - 1) // 2
    padded = np.concatenate([np.repeat(x[0], half), x, np.repeat(x[-1], half)])
    expected = np.convolve(padded, np.ones(kernel) / kernel, "valid")
    np.testing.assert_allclose(ordered(series.moving_average(bins(spark, x), ["track"], [kernel]), "trend")[0], expected)
    with pytest.raises(ValueError):
        series.moving_average(bins(spark, x), ["track"], [4])


def test_window_normalisation_and_patches(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0, 9.0, 3.0],)], "x array<double>")
    for last in (False, True):
        w = series.normalise_windows(df, subtract_last=last)
        row = series.denormalise(w.withColumn("back", F.col("x_norm")), "back").first()
        x = np.array(row.x)
        np.testing.assert_allclose(row.x_norm, (x - (x[-1] if last else x.mean())) / np.sqrt(x.var() + 1e-5))
        np.testing.assert_allclose(row.back, x)
    got = series.patches(df, 3, 2, 2).first().patches
    assert got == [[1.0, 2.0, 4.0], [4.0, 9.0, 3.0], [3.0, 3.0, 3.0]]


def test_downsampling_drops_tails(spark):
    x = np.arange(11.0)
    for method, f in (("avg", np.mean), ("max", np.max)):
        out = series.downsample(bins(spark, x), ["track"], 2, 2, method).collect()
        got = {(r.layer, r.pooled_idx): r.value for r in out}
        want = {(1, i): f(x[2 * i:2 * i + 2]) for i in range(5)} | {(2, i): f(x[4 * i:4 * i + 4]) for i in range(2)}
        assert got == want


def test_spectrum(spark):
    t = np.arange(48)
    x = 3 + 2 * np.sin(2 * np.pi * t / 12) + np.cos(2 * np.pi * t / 8) + 0.01 * RNG.normal(size=48)
    b = bins(spark, x)
    top = spectral.dominant_periods(b, ["track"], 2).orderBy("rank").collect()
    assert [(r.frequency, r.period) for r in top] == [(4, 12), (6, 8)]
    season, trend = ordered(spectral.season_trend(b, ["track"], 3), "season", "trend")
    np.testing.assert_allclose(season + trend, x)
    np.testing.assert_allclose(season, x - 3, atol=0.1)
    fit = spectral.harmonic_extrapolation(b, ["track"], 2, 24).orderBy("step").collect()
    t2 = np.arange(72)
    np.testing.assert_allclose([r.fitted for r in fit],
                               2 * np.sin(2 * np.pi * t2 / 12) + np.cos(2 * np.pi * t2 / 8), atol=0.05)


def test_baselines_equal_brute_force(spark):
    x = RNG.normal(size=30)
    gaps = {7, 20}
    out = baseline_predictions(bins(spark, x, first=100, gaps=gaps), [(4, 2), (5, 3)], 60).collect()
    want = {}
    for seq, pred in ((4, 2), (5, 3)):
        for i in range(30 - seq - pred + 1):
            if gaps & set(range(i, i + seq + pred)):
                continue
            h, y = x[i:i + seq], x[i + seq:i + seq + pred]
            at = datetime(1970, 1, 1) + timedelta(hours=100 + i + seq)
            for m, p in (("persistence", [h[-1]] * pred), ("repeat", h[-pred:]), ("level", [h.mean()] * pred)):
                want[(seq, pred, m, at)] = (np.float32(p), np.float32(y))
    assert len(out) == len(want)
    for r in out:
        p, y = want[(r.seq_len, r.pred_len, r.model, r.forecast_start)]
        np.testing.assert_allclose(r.pred, p, rtol=1e-5, atol=1e-6)
        np.testing.assert_array_equal(np.float32(r.true), y)
    with pytest.raises(ValueError):
        baseline_predictions(bins(spark, x), [(2, 3)], 60)


def all_windows(parts, seq, pred):
    xs, ys = [], []
    for v in parts:
        for i in range(len(v) - seq - pred + 1):
            xs.append(v[i:i + seq])
            ys.append(v[i + seq:i + seq + pred])
    return np.array(xs), np.array(ys)


def five_terms(spark):
    parts = [np.cumsum(RNG.normal(size=40)) for _ in range(5)]
    df = None
    for i, v in enumerate(parts):
        one = bins(spark, v, first=1000 * i, term=f"t{i}", term_idx=i)
        df = one if df is None else df.union(one)
    return parts, df.withColumn("fold", ((F.col("term_idx") + 1) % 5).cast("int"))


@pytest.mark.parametrize("model", [
    forecast.LinearModel(3, 2), forecast.LinearModel(3, 2, norm="mean", ridge=0.1),
    forecast.LinearModel(3, 2, norm="last"), forecast.LinearModel(3, 2, decompose=True, ridge=0.1)])
def test_linear_fit_equals_plain_least_squares(spark, model):
    parts, df = five_terms(spark)
    weights = forecast.fit_folds(df, df.select("term", "term_idx").distinct(), model, 5)
    for fold, w in weights.items():
        train = [parts[i] for i in range(5) if (i - fold) % 5 < 3]
        x, y = all_windows(train, 3, 2)
        c, s = model.scale(x)
        z = model.features((x - c) / s)
        expected = np.linalg.lstsq(z.T @ z + model.ridge * np.eye(z.shape[1]), z.T @ ((y - c) / s), rcond=None)[0]
        np.testing.assert_allclose(z @ w, z @ expected, atol=1e-6)
    rows = forecast.linear_predictions(df, model, weights, 60, "m").collect()
    x, y = all_windows(parts, 3, 2)
    assert len(rows) == len(x)
    fold0 = [r for r in rows if r.fold == 0]
    x4, y4 = all_windows([parts[4]], 3, 2)
    c, s = model.scale(x4)
    p4 = model.features((x4 - c) / s) @ weights[0] * s + c
    got = sorted((r.forecast_start, r.pred, r.true) for r in fold0)
    np.testing.assert_allclose([g[1] for g in got], p4)
    np.testing.assert_allclose([g[2] for g in got], y4)


def test_recursive_roll_out(spark):
    parts, df = five_terms(spark)
    model = forecast.LinearModel(3, 1)
    weights = forecast.fit_folds(df, df.select("term", "term_idx").distinct(), model, 5)
    rows = sorted((r.forecast_start, r.pred) for r in
                  forecast.recursive_predictions(df, model, weights, 3, 60, "m").collect() if r.fold == 0)
    x, _ = all_windows([parts[4]], 3, 3)
    want = []
    for h in x:
        h, steps = list(h), []
        for _ in range(3):
            v = float((np.concatenate([[1], h[-3:]]) @ weights[0]).item())
            steps.append(v)
            h.append(v)
        want.append(steps)
    np.testing.assert_allclose([r[1] for r in rows], want)


def test_autoregression_and_fallback(spark):
    x = RNG.normal(size=12).cumsum()
    _, df = five_terms(spark)
    got = forecast.autoregression(x[None, :], 3, lags=2)[0]
    z = np.stack([np.ones(10), x[1:-1], x[:-2]], axis=1)
    c = np.linalg.lstsq(z, x[2:], rcond=None)[0]
    a, b, want = x[-1], x[-2], []
    for _ in range(3):
        a, b = c[0] + c[1] * a + c[2] * b, a
        want.append(a)
    np.testing.assert_allclose(got, want)
    constant = bins(spark, [2.0] * 10).withColumn("fold", F.lit(0))
    for r in forecast.stat_predictions(constant, "ar", 5, 2, 60).collect():
        np.testing.assert_allclose(r.pred, [2.0, 2.0])

    @forecast.STAT_MODELS.holding("broken")
    def _broken(histories, steps):
        out = np.repeat(histories[:, :1] * 0, steps, axis=1)
        out[0, 0] = np.nan
        return out
    try:
        rows = sorted((r.forecast_start, r.pred) for r in
                      forecast.stat_predictions(bins(spark, range(9)).withColumn("fold", F.lit(0)), "broken", 4, 2, 60).collect())
        assert rows[0][1] == [3.0, 3.0] and rows[1][1] == [0.0, 0.0]
    finally:
        forecast.STAT_MODELS._entries.pop("broken")
    with pytest.raises(KeyError):
        forecast.stat_predictions(df, "nope", 4, 2, 60)


def test_losses(spark):
    df = spark.createDataFrame([(0.0, 0.5), (3.0, 1.0), (-1.0, -2.0)], "p double, t double")
    got = {n: df.agg(LOSSES[n](F.col("p"), F.col("t"))).first()[0] for n in ("mse", "mae", "huber", "weighted_mse")}
    assert got["mse"] == pytest.approx((0.25 + 4 + 1) / 3)
    assert got["mae"] == pytest.approx(3.5 / 3)
    assert got["huber"] == pytest.approx((0.125 + 1.5 + 0.5) / 3)
    assert got["weighted_mse"] == pytest.approx((1.5 * 0.25 + 2 * 4 + 1) / 3)
    with pytest.raises(KeyError):
        LOSSES["nope"]


def test_recurrences_over_many_slices(spark, monkeypatch):
    """One hot series, cut into slices of 16: the same values as a loop over all of it."""
    from fluxlake.operators import series

    monkeypatch.setattr(series, "SLICE", 16)
    rng = np.random.default_rng(3)
    idx = np.sort(rng.choice(2000, 500, replace=False))
    rows = [("hot", int(i), float(v)) for i, v in zip(idx, rng.normal(5, 1, 500))] + [("one", 31, 2.0), ("two", 15, 1.0), ("two", 16, 4.0)]
    df = spark.createDataFrame(rows, "series string, bin_idx long, value double").repartition(4)

    def by_loop(values, alpha, beta):
        level, slope = values[0], (values[1] - values[0] if len(values) > 1 else 0.0)
        ema, out = values[0], [(values[0], values[0])]
        for x in values[1:]:
            ema = alpha * x + (1 - alpha) * ema
            moved = alpha * x + (1 - alpha) * (level + slope)
            slope = beta * (moved - level) + (1 - beta) * slope
            level = moved
            out.append((ema, level))
        return out

    for name in ("hot", "one", "two"):
        own = df.filter(F.col("series") == name)
        values = [v for s, _, v in rows if s == name]
        want = by_loop(values, 0.3, 0.2)
        ema = [r.trend for r in series.ema(own, ["series"], 0.3).orderBy("bin_idx").collect()]
        double = [r.trend for r in series.double_ema(own, ["series"], 0.3, 0.2).orderBy("bin_idx").collect()]
        assert np.allclose(ema, [a for a, _ in want]) and np.allclose(double, [b for _, b in want])
        smooth = [r.smooth for r in series.exp_smoothing(own, ["series"], 0.6, 5.0).orderBy("bin_idx").collect()]
        state, expected = 5.0, []
        for v in values:
            state = 0.6 * state + 0.4 * v
            expected.append(state)
        assert np.allclose(smooth, expected)


def one_series(spark, values, name="s", first=100):
    rows = [(name, i + first, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, bin_idx long, value double").repartition(3)


@pytest.mark.parametrize("row,task", [(1 << 16, 1 << 18), (8, 16), (1, 4)])
def test_spectrum_of_any_length_in_tiles(spark, row, task):
    """Lengths with two factors, with none (by a chirp), and series of different lengths side by side."""
    rng = np.random.default_rng(4)
    series_of = {f"s{n}": rng.normal(size=n) for n in (1, 2, 3, 48, 61, 97, 120)}
    df = reduce(DataFrame.unionAll, [one_series(spark, v, name) for name, v in series_of.items()])
    waves = spectral.spectrum(df, ["series"], row=row, task=task).orderBy("series", "frequency").collect()
    for name, values in series_of.items():
        own = [w for w in waves if w.series == name]
        want = np.fft.rfft(values)
        assert [w.frequency for w in own] == list(range(len(want))) and {w.n for w in own} == {len(values)}
        assert np.allclose([w.re for w in own], want.real) and np.allclose([w.im for w in own], want.imag)
        amp = np.abs(want)
        amp[0] = 0
        assert np.allclose([w.amplitude for w in own], amp)
    top = spectral.spectrum(df, ["series"], k=3, inner=True, row=row, task=task).collect()
    best = spectral._strongest(spark.createDataFrame(top), ["series"], 3).orderBy("rank").collect()
    for name, values in series_of.items():
        amp = np.abs(np.fft.rfft(values))
        order = sorted((f for f in range(1, len(amp)) if 2 * f < len(values)), key=lambda f: -amp[f])[:3]
        assert [b.frequency for b in best if b.series == name] == order


def test_season_and_extrapolation_of_a_prime_length(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(size=97)
    df, n = one_series(spark, values), 97
    want = np.fft.rfft(values)
    parts = spectral.season_trend(df, ["series"], 5).orderBy("bin_idx").collect()
    amp = np.abs(want)
    amp[0] = 0
    season = np.fft.irfft(np.where(amp > np.sort(amp)[-5], want, 0), n=n)
    assert np.allclose([p.season for p in parts], season)
    fitted = spectral.harmonic_extrapolation(df, ["series"], 4, 7).orderBy("step").collect()
    keep = np.fft.irfft(np.where(amp >= np.sort(amp)[-4], want, 0), n=n)
    assert np.allclose([f.fitted for f in fitted], np.concatenate([keep, keep[:7]])) and [f.step for f in fitted] == list(range(104))


def test_long_spectrum_against_direct_sums_and_its_shuffles(spark):
    """2^18 bins: rows move once, tiles after that, and no row is longer than about the root of the length."""
    n = 1 << 18
    value = F.sin(F.col("id") * (2 * np.pi * 1000 / n)) + (F.col("id") * 7919 % 104_729) / 104_729
    df = spark.range(n).select(F.lit("s").alias("series"), F.col("id").alias("bin_idx"), value.alias("value"))
    waves = spectral.spectrum(df, ["series"], row=1 << 10, task=1 << 14)
    got = {w.frequency: w for w in waves.filter("frequency in (0, 1, 1000, 77777, 131072)").collect()}
    at = np.arange(n)
    x = np.sin(2 * np.pi * 1000 / n * at) + (at * 7919 % 104_729) / 104_729
    for f, w in got.items():
        turn = 2 * np.pi * (f * at % n) / n
        assert w.re == pytest.approx(np.sum(x * np.cos(turn)), abs=1e-5) and w.im == pytest.approx(-np.sum(x * np.sin(turn)), abs=1e-5)
    assert len(got) == 5 and waves.count() == n // 2 + 1
    top = spectral.dominant_periods(df, ["series"], 1).first()
    assert top.frequency in (1, 1000)
    # rows that a shuffle of the plan moves: the series, a row per slice, and tiles of 2^14 values
    spectral.spectrum(df, ["series"], k=1, row=1 << 10, task=1 << 14).collect()
    written = shuffled_rows(spark, lambda: spectral.spectrum(df, ["series"], k=1, row=1 << 10, task=1 << 14).collect())
    assert written <= 4 * n


def shuffled_rows(spark, action):
    """Records that shuffles write while ``action`` runs, by Spark's own counters."""
    tracker = spark.sparkContext._jsc.sc().statusStore()
    jvm = spark.sparkContext._jvm
    before = {s.stageId() for s in stages(tracker, jvm)}
    action()
    return sum(s.shuffleWriteRecords() for s in stages(tracker, jvm) if s.stageId() not in before)


def stages(tracker, jvm):
    found = tracker.stageList(None, False, False, jvm.java.lang.reflect.Array.newInstance(jvm.Double.TYPE, 0), None)
    return [found.apply(i) for i in range(found.size())]


def test_recurrences_stay_in_the_jvm_and_cross_all_levels(spark):
    """Slices of 4 rows and steps of 3 slices; gaps in the bins, one-row and two-row series."""
    rng = np.random.default_rng(8)
    series_of = {"long": rng.normal(size=100), "one": rng.normal(size=1), "two": rng.normal(size=2), "nine": rng.normal(size=9)}
    rows = [(name, 7 * i - 50 + i % 2, float(v)) for name, values in series_of.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series string, bin_idx long, value double").repartition(3)
    keep, beta = 0.6, 0.2
    double = series.Recurrence(np.array([[keep, keep], [beta * (keep - 1), beta * keep + 1 - beta]]), np.array([1 - keep, (1 - keep) * beta]))
    single = series.Recurrence(np.array([[0.7]]), np.array([0.3]))
    given = series.Recurrence(np.array([[0.7]]), np.array([0.3]), np.array([5.0]))
    for rule in (double, single, given):
        out = series.linear_recurrence(df, ["series"], rule, "bin_idx", "value", "trend", fold=4, level=3)
        assert "Python" not in out._jdf.queryExecution().toString() and "InArrow" not in out._jdf.queryExecution().toString()
        got = out.orderBy("bin_idx").collect()
        assert len(got) == len(rows)
        for name, values in series_of.items():
            if rule.initial is not None:
                state = rule.move @ rule.initial + rule.gain * values[0]
            else:
                state = np.array([values[0], values[1] - values[0] if len(values) > 1 else 0.0])[: rule.size]
            want = [state[0]]
            for v in values[1:]:
                state = rule.move @ state + rule.gain * v
                want.append(state[0])
            assert np.allclose([r.trend for r in got if r.series == name], want)


def test_frames_and_pools_of_a_hot_series_in_slices(spark):
    """Slices of 16 positions; the kernel is wider than a slice, than a series, or a single row."""
    rng = np.random.default_rng(9)
    series_of = {"hot": rng.normal(size=300), "one": rng.normal(size=1), "few": rng.normal(size=5)}
    df = reduce(DataFrame.unionAll, [one_series(spark, v, name) for name, v in series_of.items()])
    for kernels in ([1], [5, 25], [41]):
        got = series.moving_average(df, ["series"], kernels, width=16).orderBy("bin_idx").collect()
        for name, x in series_of.items():
            want = sum(np.convolve(np.pad(x, (k - 1) // 2, "edge"), np.ones(k) / k, "valid") for k in kernels) / len(kernels)
            assert np.allclose([r.trend for r in got if r.series == name], want)
    dealt = series.moving_average(df, ["series"], [5], width=16)
    windows = [line for line in dealt._jdf.queryExecution().toString().splitlines() if "RowFrame, -2, 2" in line]
    assert windows and all("_block" in line for line in windows)
    pooled = {(r.series, r.layer, r.pooled_idx): r.value for r in series.downsample(df, ["series"], 4, 2).collect()}
    want = {(name, i, j): x[j * 4**i: (j + 1) * 4**i].mean() for name, x in series_of.items() for i in (1, 2) for j in range(len(x) // 4**i)}
    assert pooled.keys() == want.keys() and all(np.isclose(pooled[k], want[k]) for k in want)


def test_autoregression_with_two_lags():
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.normal(size=(1, 40)), axis=1)
    design = np.column_stack([np.ones(38), x[0, 1:-1], x[0, :-2]])
    c = np.linalg.lstsq(design, x[0, 2:], rcond=None)[0]
    one = c @ [1, x[0, -1], x[0, -2]]
    assert np.allclose(forecast.STAT_MODELS["ar"].fn(x, 2, lags=2), [[one, c @ [1, one, x[0, -1]]]])
