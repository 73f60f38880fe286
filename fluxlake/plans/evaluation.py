"""Queries that score prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlake.functions.registry import RUN_KEYS
from fluxlake.functions.scores import EVENT_SCORES, EXTRA_SCORES, score_columns
from fluxlake.operators.evaluate import evaluate
from fluxlake.plans.common import r, rounded
from fluxlake.plans.runs import (
    CUT_HOURS, DAY_MIN, EVENT_MASTERS_SQL, EVENT_THRESHOLDS, ORDER_MASTERS_SQL, ORDER_PRED_SQL, RUN, SCORE_SQL,
    THRESHOLDS, case_of, event_predictions, masters_sql, order_predictions, score_list,
)

# values in the space of the order predictions, taken as physical ones
PLAIN_THRESHOLDS = {"F": 5.52, "O": 5.48, "P": 5.5}

COUNT_COLS = ["channel", "granularity", "threshold", "n", "n_events", "tp", "fp", "fn", "tn",
              "n_nonfinite"]
_COUNTS_SQL = ", ".join(COUNT_COLS)


def _unit(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = evaluate(event_predictions(spark, d), EVENT_THRESHOLDS, metrics=[], units=[name]).event
        return rows.select(*RUN_KEYS, *COUNT_COLS)
    return query


def _unit_sql(name: str) -> str:
    return (f"WITH {EVENT_MASTERS_SQL} SELECT {RUN}, {_COUNTS_SQL} FROM evt "
            f"WHERE granularity = '{name}'")


def event_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluate(order_predictions(spark, d), THRESHOLDS, day_hours=CUT_HOURS,
                    metrics=list(EVENT_SCORES)).event
    extra = rows.select("*", *score_columns(list(EXTRA_SCORES), EXTRA_SCORES))
    return rounded(extra.select(*RUN_KEYS, *COUNT_COLS, *EVENT_SCORES, *EXTRA_SCORES),
                   [*EVENT_SCORES, *EXTRA_SCORES])


EXTRA_SQL = {
    "mcc": ("CASE WHEN (tp+fp) > 0 AND (tp+fn) > 0 AND (tn+fp) > 0 AND (tn+fn) > 0 THEN "
            "(tp*1.0*tn - fp*1.0*fn)/sqrt((tp+fp)*1.0*(tp+fn)*(tn+fp)*(tn+fn)) END"),
    "precision": "CASE WHEN tp+fp > 0 THEN tp*1.0/(tp+fp) END",
    "fb": "CASE WHEN tp+fn > 0 THEN (tp+fp)*1.0/(tp+fn) END",
    "pofd": "CASE WHEN fp+tn > 0 THEN fp*1.0/(fp+tn) END",
    "base": "(tp+fn)*1.0/n",
}


def regression_scores(spark: SparkSession, d: str) -> DataFrame:
    names = ["rmse", "mae", "msa", "sspb", "logr"]
    rows = evaluate(order_predictions(spark, d), None, metrics=names).regression
    return rounded(rows.select(*RUN_KEYS, "channel", "n", *names), names)


def _day_number(col: str = "forecast_start") -> Column:
    return F.unix_date(F.col(col).cast("date"))


def nonfinite_scores(spark: SparkSession, d: str) -> DataFrame:
    """One model predicts NaN first on every seventh day: its channels are voided, the others stand."""
    spoilt = (F.col("model") == "level") & (_day_number() % 7 == 0)
    nan = F.transform("pred", lambda v, i: F.when(i == 0, F.lit(float("nan"))).otherwise(v))
    pred = order_predictions(spark, d).withColumn("pred", F.when(spoilt, nan).otherwise(F.col("pred")))
    rows = evaluate(pred, THRESHOLDS, metrics=["hss"], units=["point", "window"]).event
    return rounded(rows.select(*RUN_KEYS, "channel", "granularity", "n", "n_nonfinite", "tp", "fp", "fn", "tn", "hss"), ["hss"])


def untransformed_scores(spark: SparkSession, d: str) -> DataFrame:
    """Predictions that are stored as they are: thresholds unchanged, log metrics take logarithms first."""
    ev = evaluate(order_predictions(spark, d), PLAIN_THRESHOLDS, transform="none", units=["window"],
                  metrics=["rmse", "msa", "sspb", "logr", "hss"])
    window = ev.event.select(*RUN_KEYS, "channel", "tp", "fp", "fn", "tn")
    out = ev.regression.select(*RUN_KEYS, "channel", "n", "rmse", "msa", "sspb", "logr").join(window, [*RUN_KEYS, "channel"])
    return rounded(out, ["rmse", "msa", "sspb", "logr"])


def day_cut_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Daily cut where one model lacks every second day and every start is there twice: each run is cut on its
    own starts, and of a repeated start the first position counts."""
    pred = order_predictions(spark, d).filter(~((F.col("model") == "level") & (_day_number() % 2 == 1)))
    wrong = F.transform("pred", lambda v: v + 9)
    twice = pred.withColumn("position", F.lit(0)).unionByName(pred.withColumn("position", F.lit(1)).withColumn("pred", wrong))
    rows = evaluate(twice, THRESHOLDS, day_hours=CUT_HOURS, metrics=[], units=["day"]).event
    return rows.select(*RUN_KEYS, *COUNT_COLS)


def _filtered(condition: str) -> str:
    return (ORDER_PRED_SQL.replace("pred AS MATERIALIZED (", "pred0 AS MATERIALIZED (")
            + f", pred AS MATERIALIZED (SELECT * FROM pred0 WHERE {condition})")


_LACKING = _filtered("NOT (model = 'level' AND fs % 2 = 1)")
_PLAIN = case_of(PLAIN_THRESHOLDS)
_HIT = f"SELECT *, p >= CAST({_PLAIN} AS REAL) AS ep, y >= CAST({_PLAIN} AS REAL) AS ey FROM pred"
_REG_SQL = ", ".join(r(c, c) for c in ("rmse", "mae", "msa", "sspb", "logr"))

QUERIES = {
    "contingency_point": (_unit("point"), _unit_sql("point")),
    "contingency_window": (_unit("window"), _unit_sql("window")),
    "contingency_day": (_unit("day"), _unit_sql("day")),
    "event_scores": (event_scores, (
        f"WITH {ORDER_MASTERS_SQL} SELECT {RUN}, {_COUNTS_SQL}, {score_list()}, "
        + ", ".join(f"{r(e)} AS \"{n}\"" for n, e in EXTRA_SQL.items()) + " FROM evt")),
    "regression_scores": (regression_scores, (
        f"WITH {ORDER_MASTERS_SQL} SELECT {RUN}, channel, n, {_REG_SQL} FROM reg")),
    "nonfinite_scores": (nonfinite_scores, f"""WITH {ORDER_MASTERS_SQL},
      x AS (SELECT *, model = 'level' AND fs % 7 = 0 AND lead = 0 AS bad, p >= thr AS ep, y >= thr AS ey FROM lab),
      u AS (SELECT {RUN}, channel, 'point' AS granularity, bad, ep, ey FROM x UNION ALL
            SELECT {RUN}, channel, 'window', bool_or(bad), bool_or(ep), bool_or(ey) FROM x GROUP BY {RUN}, channel, fs),
      c AS (SELECT {RUN}, channel, granularity, count(*) AS n, count_if(bad) AS n_nonfinite, count_if(ep AND ey) AS tp,
            count_if(ep AND NOT ey) AS fp, count_if(NOT ep AND ey) AS fn, count_if(NOT ep AND NOT ey) AS tn FROM u GROUP BY {RUN}, channel, granularity),
      v AS (SELECT {RUN}, channel, sum(n_nonfinite) > 0 AS void FROM c GROUP BY {RUN}, channel)
      SELECT {RUN}, channel, granularity, n, n_nonfinite, CASE WHEN NOT void THEN tp END AS tp, CASE WHEN NOT void THEN fp END AS fp,
        CASE WHEN NOT void THEN fn END AS fn, CASE WHEN NOT void THEN tn END AS tn, CASE WHEN NOT void THEN {r(SCORE_SQL['hss'])} END AS hss
      FROM c JOIN v USING ({RUN}, channel)"""),
    "untransformed_scores": (untransformed_scores, f"""WITH {ORDER_PRED_SQL},
      g AS (SELECT {RUN}, channel, count(*) AS n, sqrt(avg((p::DOUBLE-y)*(p::DOUBLE-y))) AS rmse,
            median(abs(log10(p::DOUBLE) - log10(y::DOUBLE))) AS ma, median(log10(p::DOUBLE) - log10(y::DOUBLE)) AS md,
            CASE WHEN min(p) < max(p) AND min(y) < max(y) THEN corr(log10(p::DOUBLE), log10(y::DOUBLE)) END AS logr FROM pred GROUP BY {RUN}, channel),
      w AS (SELECT {RUN}, channel, bool_or(ep) AS ep, bool_or(ey) AS ey FROM ({_HIT}) GROUP BY {RUN}, channel, fs),
      c AS (SELECT {RUN}, channel, count_if(ep AND ey) AS tp, count_if(ep AND NOT ey) AS fp, count_if(NOT ep AND ey) AS fn,
            count_if(NOT ep AND NOT ey) AS tn FROM w GROUP BY {RUN}, channel)
      SELECT {RUN}, channel, n, {r('rmse', 'rmse')}, {r('100*(10**ma - 1)', 'msa')}, {r('sign(md)*100*(10**abs(md) - 1)', 'sspb')},
        {r('logr', 'logr')}, tp, fp, fn, tn FROM g JOIN c USING ({RUN}, channel)"""),
    "day_cut_repeats": (day_cut_repeats, (
        f"WITH {masters_sql(_LACKING, THRESHOLDS, CUT_HOURS, DAY_MIN)} "
        f"SELECT {RUN}, {_COUNTS_SQL} FROM evt WHERE granularity = 'day'")),
}
