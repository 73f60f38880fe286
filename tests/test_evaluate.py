import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxlake.functions.calendar import time_micros
from fluxlake.operators.daycut import spaced_starts
from fluxlake.operators.evaluate import check_predictions, evaluate, from_long, to_long
from fluxlake.operators.median import grouped_median

T0 = datetime(2020, 1, 1)
SCHEMA = ("track string, seq_len int, pred_len int, fold int, strategy string, model string, "
          "channel string, forecast_start timestamp, pred array<float>, true array<float>")


def predictions(spark, pred, true, hours, channel="c", model="m"):
    rows = [("t", 3, len(pred[0]), 0, "direct", model, channel, T0 + timedelta(hours=h), p, t)
            for p, t, h in zip(pred, true, hours)]
    return spark.createDataFrame(rows, SCHEMA)


PRED = [[2.0, 0.0], [0.0, 0.0], [0.0, 2.0], [2.0, 2.0], [0.0, 0.0]]
TRUE = [[0.0, 2.0], [0.0, 0.0], [0.0, 0.0], [2.0, 0.0], [2.0, 0.0]]
HOURS = [0, 12, 24, 30, 48]


def units(rows):
    return {r.granularity: (r.n, r.n_events, r.tp, r.fp, r.fn, r.tn) for r in rows}


def test_three_units(spark):
    ev = evaluate(predictions(spark, PRED, TRUE, HOURS), {"c": 10.0})
    got = units(ev.event.collect())
    assert got == {"point": (10, 3, 1, 3, 2, 4), "window": (5, 3, 2, 1, 1, 1), "day": (3, 2, 1, 1, 1, 0)}


def test_non_finite_voids_the_channel_only(spark):
    bad = [list(p) for p in PRED]
    bad[1][0] = math.inf      # this window is dropped by the cut
    both = predictions(spark, bad, TRUE, HOURS, "a").unionByName(
        predictions(spark, PRED, TRUE, HOURS, "b"))
    ev = evaluate(both, {"a": 10.0, "b": 10.0})
    rows = ev.event.collect()
    a = {r.granularity: r for r in rows if r.channel == "a"}
    assert [a[g].n_nonfinite for g in ("point", "window", "day")] == [1, 1, 0]
    assert all(a[g].tp is None and a[g].hss is None and a[g].n_events is None for g in a)
    assert [a[g].n for g in ("point", "window", "day")] == [10, 5, 3]
    b = units([r for r in rows if r.channel == "b"])
    assert b["day"] == (3, 2, 1, 1, 1, 0)
    reg = {r.channel: r for r in ev.regression.collect()}
    assert reg["a"].rmse is None and reg["a"].msa is None and reg["a"].n == 10
    assert reg["b"].rmse is not None


def test_nan_prediction_is_not_an_event(spark):
    bad = [list(p) for p in PRED]
    bad[0][0] = math.nan
    row = evaluate(predictions(spark, bad, TRUE, HOURS), {"c": 10.0}).event.filter(
        "granularity = 'point'").first()
    assert row.tp is None and row.n_nonfinite == 1


def test_regression_matches_numpy(spark):
    rng = np.random.default_rng(0)
    p, t = rng.normal(size=(40, 3)).astype("float32"), rng.normal(size=(40, 3)).astype("float32")
    row = evaluate(predictions(spark, p.tolist(), t.tolist(), range(40)), None).regression.first()
    d = p.astype(float) - t.astype(float)
    m = np.median(d)
    assert row.rmse == pytest.approx(np.sqrt((d * d).mean()))
    assert row.msa == pytest.approx(100 * (10 ** np.median(np.abs(d)) - 1))
    assert row.sspb == pytest.approx(np.sign(m) * 100 * (10 ** abs(m) - 1))
    assert row.logr == pytest.approx(np.corrcoef(p.ravel(), t.ravel())[0, 1])


def test_physical_space_needs_positive_values(spark):
    rows = predictions(spark, [[1.0, 10.0]], [[2.0, 5.0]], [0])
    ok = evaluate(rows, None, transform="none").regression.first()
    assert ok.msa == pytest.approx(100 * (10 ** np.median(np.abs(np.log10([0.5, 2.0]))) - 1), rel=1e-6)
    zero = predictions(spark, [[0.0, 10.0]], [[2.0, 5.0]], [0])
    row = evaluate(zero, None, transform="none").regression.first()
    assert row.msa is None and row.logr is None and row.rmse is not None


def test_threshold_is_inclusive_at_float_precision(spark):
    thr = float(np.float32(np.log10(30.0)))
    row = evaluate(predictions(spark, [[thr]], [[thr]], [0]), {"c": 30.0}).event.filter(
        "granularity = 'point'").first()
    assert row.tp == 1


def test_unselected_metrics_stay_as_null_columns(spark):
    ev = evaluate(predictions(spark, PRED, TRUE, HOURS), {"c": 10.0}, metrics=["mae", "hss"])
    assert ev.regression.first().rmse is None and ev.regression.first().mae is not None
    row = ev.event.first()
    assert row.tss is None and row.n is not None
    with pytest.raises(KeyError):
        evaluate(predictions(spark, PRED, TRUE, HOURS), None, metrics=["nope"])


def test_long_form_round_trip(spark):
    p = predictions(spark, PRED, TRUE, HOURS)
    assert sorted(map(str, from_long(to_long(p)).select(p.columns[7:]).collect())) == sorted(
        map(str, p.select(p.columns[7:]).collect()))


def test_shape_check(spark):
    p = predictions(spark, [[1.0, 2.0]], [[1.0, 2.0]], [0]).withColumn("pred_len", F.lit(3))
    with pytest.raises(Exception, match="pred_len values"):
        check_predictions(p).collect()


def greedy(hours, gap):
    kept = []
    for h in sorted(hours):
        if not kept or h >= kept[-1] + gap:
            kept.append(h)
    return kept


def cut(spark, hours, gap=24):
    df = spark.createDataFrame([("a", T0 + timedelta(hours=h)) for h in hours], "k string, t timestamp")
    rows = spaced_starts(df, ["k"], "t", gap).collect()
    return sorted((r.t - T0).total_seconds() / 3600 for r in rows)


@pytest.mark.parametrize("hours,gap,kept", [
    ([0, 1, 23, 24, 25, 60, 84, 85, 108.5], 24, [0, 24, 60, 84, 108.5]),
    ([24, 0, 60], 24, [0, 24, 60]), ([24, 0, 0, 24], 24, [0, 24]), ([0, 3, 6, 7, 12], 6, [0, 6, 12])])
def test_day_cut_vectors(spark, hours, gap, kept):
    assert cut(spark, hours, gap) == kept


def test_day_cut_needs_positive_hours(spark):
    with pytest.raises(ValueError):
        cut(spark, [0], 0)


def test_day_cut_equals_greedy_loop_across_blocks(spark):
    rng = np.random.default_rng(1)
    rows, expected = [], {}
    for k in range(6):
        steps = rng.choice([1, 2, 3, 30, 200], size=1500, p=[0.5, 0.2, 0.2, 0.08, 0.02])
        hours = np.cumsum(steps).tolist()
        expected[k] = greedy(hours, 24)
        rows += [(k, T0 + timedelta(hours=int(h))) for h in hours]
    df = spark.createDataFrame(rows, "k int, t timestamp")
    got = {}
    for r in spaced_starts(df, ["k"], "t").collect():
        got.setdefault(r.k, []).append((r.t - T0).total_seconds() / 3600)
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_grouped_median_is_exact(spark):
    rng = np.random.default_rng(2)
    groups = {"even": rng.normal(size=5000), "odd": rng.normal(size=4001), "ties": rng.integers(0, 3, 999) * 1.0,
              "one": np.array([3.5]), "skew": np.exp(rng.normal(size=3000) * 4)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("one", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for accuracy in (200, 20_000):
        got = {r.k: r.median for r in grouped_median(df, ["k"], "v", accuracy=accuracy).collect()}
        for k, vs in groups.items():
            assert got[k] == pytest.approx(np.median(vs), abs=0)


def test_times_as_nanoseconds_and_refused_kinds(spark):
    hour = 3_600_000_000_000
    base = 1_700_000_000_123_456_789
    df = spark.createDataFrame([("a", base + k * 7 * hour) for k in range(12)], "k string, t long")
    got = sorted(r.t for r in spaced_starts(df, ["k"], "t").collect())
    assert got == [base // 1000 * 1000 + k * 7 * hour for k in (0, 4, 8)]
    naive = df.select("k", F.timestamp_micros(F.expr("t div 1000")).cast("timestamp_ntz").alias("t"))
    assert [r.t.hour for r in spaced_starts(naive, ["k"], "t").orderBy("t").collect()] == [22, 2, 6]
    before = spark.createDataFrame([("a", -1)], "k string, t long").select(time_micros(df, "t").alias("m")).first().m
    assert before == -1
    for kind in ("double", "float", "string", "boolean", "date"):
        with pytest.raises(TypeError, match="integer nanoseconds"):
            spaced_starts(spark.createDataFrame([], f"k string, t {kind}"), ["k"], "t")


def test_medians_are_narrowed_by_rank_where_values_cluster(spark):
    """Heavy tails: nearly all values of a group lie in a sliver of its range; the largest ordered step is bounded."""
    from fluxlake.operators import median

    rng = np.random.default_rng(11)
    groups = {"tail": np.exp(rng.normal(0, 8, 4001)), "sliver": np.concatenate([1 + rng.random(6000) * 1e-9, [-1e12, 1e12]]),
              "even": rng.normal(size=4000), "few": np.array([1.0, 5.0]), "same": np.full(3000, 7.0)}
    rows = [(k, float(v), float(-v)) for k, values in groups.items() for v in values] + [("none", None, None), (None, 3.0, None)]
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(4)
    # a coarse sketch leaves long brackets
    got = {r.k: (r.v, r.w) for r in median.grouped_medians(df, ["k"], ["v", "w"], accuracy=40, ordered=30).collect()}
    for k, values in groups.items():
        assert got[k] == (np.median(values), np.median(-values)), k
    assert got[None] == (3.0, None)
    inside = df.filter("k = 'sliver'").groupBy("k", F.lit("v").alias("name"), "v").agg(F.count("*").alias("_c")).withColumns(
        {"n": F.lit(6002).cast("long"), "_before": F.lit(0).cast("long")})
    once = median.narrowed(inside, ["k"])
    assert median.longest(inside, ["k"]) == inside.count() and median.longest(once, ["k"]) <= 60
    assert median.longest(median.narrowed(once, ["k"]), ["k"]) <= 4
