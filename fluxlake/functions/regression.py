"""Regression metrics as aggregate columns over ``(pred, true)``, kept on a shelf.

Metrics built from sums are one aggregate expression each. Metrics that need an exact median
name the quantity whose median they need and a function of that median; the scorer computes all
medians in one extra pass (see ``operators.median``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxlake.functions.registry import Shelf

LN10 = 2.302585092994046

# Facts of an entry: ``space`` ("stored" or "log") of its arguments; for a metric of a median,
# ``median_of`` is the quantity and the entry itself turns the median into the metric.
REGRESSION_METRICS = Shelf("regression metric")


def percent_factor(m: Column) -> Column:
    """100 * (10**m - 1), exact for small ``m``."""
    return F.expm1(m * LN10) * 100


@REGRESSION_METRICS.holding("rmse", space="stored")
def _rmse(pred, true):
    return F.sqrt(F.avg((pred - true) * (pred - true)))


@REGRESSION_METRICS.holding("mae", space="stored")
def _mae(pred, true):
    return F.avg(F.abs(pred - true))


REGRESSION_METRICS.holding("msa", space="log", median_of=lambda p, t: F.abs(p - t))(percent_factor)


@REGRESSION_METRICS.holding("sspb", space="log", median_of=lambda p, t: p - t)
def _sspb(middle):
    return F.signum(middle) * percent_factor(F.abs(middle))


@REGRESSION_METRICS.holding("logr", larger_is_better=True, space="log")
def _logr(pred, true):
    # a constant side has no correlation; min = max is exact where a variance is not
    varies = (F.min(pred) < F.max(pred)) & (F.min(true) < F.max(true))
    r = F.try_divide(F.covar_pop(pred, true), F.stddev_pop(pred) * F.stddev_pop(true))
    return F.when(varies, r)
