import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxlake.functions import regression, scores
from fluxlake.functions.metrics import STANDARD

COUNTS = "tp long, fp long, fn long, tn long"


def table(spark, rows, names=None, registry=scores.EVENT_SCORES):
    df = spark.createDataFrame(rows, COUNTS)
    names = names or list(registry)
    return [r.asDict() for r in df.select("*", *scores.score_columns(names, registry)).collect()]


def log_share(a, b):
    return math.log(a / b)


def by_hand(tp, fp, fn, tn):
    """The scores from their definitions, in whole numbers as long as possible; None where a quotient has no value."""
    n = tp + fp + fn + tn
    share = lambda a, b: Fraction(a, b) if b else None
    pod, pofd = share(tp, tp + fn), share(fp, fp + tn)
    hits_by_chance = share((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n)
    out = {
        "pod": pod, "far": share(fp, tp + fp), "csi": share(tp, n - tn), "f1": share(2 * tp, 2 * tp + fp + fn),
        "tss": None if None in (pod, pofd) else pod - pofd,
        "hss": None if hits_by_chance == n else (tp + tn - hits_by_chance) / (n - hits_by_chance),
        "seds": None, "sedi": None}
    if 0 < tp < n:
        out["seds"] = (log_share(tp + fp, n) + log_share(tp + fn, n)) / log_share(tp, n) - 1
    if min(tp, fp, fn, tn) > 0:
        f, h = (math.log(x) for x in (pofd, pod))
        rest_f, rest_h = math.log(1 - pofd), math.log(1 - pod)
        out["sedi"] = (f - h - rest_f + rest_h) / (f + h + rest_f + rest_h)
    return out


def test_scores_equal_their_definitions(spark):
    rng = random.Random(31)
    rows = [tuple(rng.choice((0, 1, rng.randrange(200))) for _ in range(4)) for _ in range(150)]
    rows = [r for r in rows if sum(r)]
    for counts, got in zip(rows, table(spark, rows), strict=True):
        for name, want in by_hand(*counts).items():
            assert (got[name] is None) == (want is None), (name, counts)
            assert want is None or got[name] == pytest.approx(float(want), rel=1e-9, abs=1e-12), (name, counts)


def test_scores_of_no_samples_are_undefined(spark):
    assert all(table(spark, [(0, 0, 0, 0)])[0][name] is None for name in scores.EVENT_SCORES)


def test_zero_is_not_undefined(spark):
    assert table(spark, [(0, 3, 0, 7)], ["csi"])[0]["csi"] == 0


def test_no_count_combination_raises(spark):
    rows = list(itertools.product((0, 1, 7), repeat=4))
    assert len(table(spark, rows)) == 81
    legacy = table(spark, rows, registry=scores.LEGACY_SCORES)
    assert all(v is not None for r in legacy for v in r.values())


def test_extra_scores(spark):
    for tp, fp, fn, tn in ((17, 4, 9, 41), (3, 12, 1, 8)):
        row = table(spark, [(tp, fp, fn, tn)], registry=scores.EXTRA_SCORES)[0]
        n = tp + fp + fn + tn
        want = {"precision": tp / (tp + fp), "fb": (tp + fp) / (tp + fn), "pofd": fp / (fp + tn), "base": (tp + fn) / n}
        seen, told = ([1] * tp + [0] * fp + [1] * fn + [0] * tn), ([1] * (tp + fp) + [0] * (fn + tn))
        want["mcc"] = np.corrcoef(seen, told)[0, 1]
        assert {k: row[k] for k in want} == pytest.approx(want)


def regress(spark, pred, true, name):
    df = spark.createDataFrame(list(zip(pred, true)), "p double, t double")
    m = regression.REGRESSION_METRICS[name]
    p, t = F.col("p"), F.col("t")
    if "median_of" not in m.facts:
        return df.agg(m(p, t).alias("v")).first().v
    return df.agg(F.median(m.facts["median_of"](p, t)).alias("d")).select(m(F.col("d")).alias("v")).first().v


def test_regression_metrics_equal_their_definitions(spark):
    rng = np.random.default_rng(17)
    true = rng.normal(size=41)
    pred = true + rng.normal(0.1, 0.4, size=41)
    error = pred - true
    middle = np.median(error)
    want = {"rmse": np.sqrt(np.mean(error**2)), "mae": np.mean(np.abs(error)), "logr": np.corrcoef(pred, true)[0, 1],
            "msa": 100 * (10 ** np.median(np.abs(error)) - 1), "sspb": 100 * np.sign(middle) * (10 ** abs(middle) - 1)}
    for name, value in want.items():
        assert regress(spark, pred.tolist(), true.tolist(), name) == pytest.approx(value, rel=1e-9)
    # predictions on the other side turn the signed bias over
    assert regress(spark, (true - error).tolist(), true.tolist(), "sspb") == pytest.approx(-want["sspb"], rel=1e-9)


def test_a_constant_side_has_no_correlation(spark):
    line = [i / 7 for i in range(500)]
    assert regress(spark, [0.3] * 500, line, "logr") is None and regress(spark, line, [0.3] * 500, "logr") is None


def test_metric_set_rules():
    for shelf in (scores.EVENT_SCORES, regression.REGRESSION_METRICS):
        with pytest.raises(ValueError):
            shelf.plus("a_b", max)
    with pytest.raises(KeyError):
        STANDARD.chosen(["rmse", "nope"])
    with pytest.raises(KeyError):
        scores.EVENT_SCORES["nope"]
    assert STANDARD.chosen(["rmse", "hss"]) == {"rmse", "hss"}
    assert not STANDARD.ascends("tss_p_gt10") and STANDARD.ascends("rmse") and STANDARD.ascends("unknown")
    assert STANDARD.regression_columns[-5:] == ["rmse", "mae", "msa", "sspb", "logr"]
    assert STANDARD.event_columns[-8:] == ["tss", "hss", "pod", "far", "csi", "f1", "seds", "sedi"]
    more = STANDARD.with_event("gss", lambda tp, fp, fn, tn: tp, larger_is_better=True)
    assert more.event_columns[-1] == "gss" and not more.ascends("gss") and "gss" not in STANDARD.events
