"""Scored runs that the evaluation and board queries share: baselines on the order history.

Channels are order statuses, bins are days, terms are half-years tested in rotation over five
folds, and the tracks are the three single channels and all together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlake.operators.baselines import baseline_predictions, multi_track_bins
from fluxlake.operators.evaluate import Evaluation, evaluate, master_layout
from fluxlake.operators.grid import bin_mean_wide
from fluxlake.operators.terms import term_label, term_table
from fluxlake.plans.common import EVENT_OBS, ORDER_OBS, bin_of, event_obs, order_obs, r, term_sql
from fluxlake.session import materialize

CHANNELS = ["F", "O", "P"]
TRACKS = {"uni_a": ["F"], "uni_b": ["O"], "uni_c": ["P"], "multi": CHANNELS}
CONDITIONS = [(3, 2), (3, 3), (5, 2), (5, 3)]
THRESHOLDS = {"F": 330_000.0, "O": 300_000.0, "P": 315_000.0}
N_FOLD = 5
DAY_MIN = 1440
CUT_HOURS = 48

EVENT_CONDITIONS = [(6, 3)]
EVENT_TRACKS = {c: [c] for c in ("click", "error", "purchase", "signup", "view")}
EVENT_THRESHOLDS = {c: 20.0 for c in EVENT_TRACKS}
HOUR_MIN = 60


def order_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = order_obs(spark, sf_dir)
    wide = bin_mean_wide(obs, CHANNELS, DAY_MIN, transform="log10")
    terms = term_table(obs).select("term", "term_idx")
    return multi_track_bins(wide.withColumn("term", term_label("bin_ts")).join(terms, "term"),
                            TRACKS)


def order_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions are saved once and scored from the saved table, which several passes read."""
    pred = baseline_predictions(order_bins(spark, sf_dir), CONDITIONS, DAY_MIN, N_FOLD)
    return materialize(pred, "order-predictions")


def order_masters(spark: SparkSession, sf_dir: str) -> Evaluation:
    return master_layout(evaluate(order_predictions(spark, sf_dir), THRESHOLDS,
                                  day_hours=CUT_HOURS))


def event_predictions(spark: SparkSession, sf_dir: str, cadence_min: int = HOUR_MIN) -> DataFrame:
    obs = event_obs(spark, sf_dir)
    wide = bin_mean_wide(obs, list(EVENT_TRACKS), cadence_min, transform="log10")
    bins = multi_track_bins(wide.withColumn("term", term_label("bin_ts")), EVENT_TRACKS)
    return materialize(baseline_predictions(bins, EVENT_CONDITIONS, cadence_min),
                       "event-predictions")


# ---- SQL counterparts -------------------------------------------------------------------------

def _track_union(tracks: dict[str, list[str]], with_term_idx: bool) -> str:
    extra = ", term_idx" if with_term_idx else ", 0 AS term_idx"
    parts = []
    for track, chans in tracks.items():
        names = ", ".join(f"'{c}'" for c in chans)
        parts.append(
            f"SELECT '{track}' AS track, series AS channel, term{extra}, idx, value FROM b "
            f"WHERE series IN ({names}) AND value IS NOT NULL "
            f"QUALIFY count(*) OVER (PARTITION BY idx) = {len(chans)}")
    return " UNION ALL ".join(parts)


def predictions_sql(obs: str, minutes: int, tracks: dict, conditions: list, n_fold: int | None) -> str:
    """CTE list ending in ``pred``: one row per (run, channel, window, lead), values as REAL.

    Built lead by lead with joins on the bin number, independently of the row frames in Spark.
    """
    conds = ", ".join(f"({s}, {p})" for s, p in conditions)
    fold = f"CAST((term_idx + 1) % {n_fold} AS INTEGER)" if n_fold else "0"
    return f"""
    obs AS ({obs}),
    terms AS MATERIALIZED (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_idx
              FROM (SELECT DISTINCT {term_sql('t')} AS term FROM obs)),
    b0 AS (SELECT series, {bin_of('t', minutes)} AS idx, {term_sql('t')} AS term,
                  CASE WHEN avg(v) > 0 THEN log10(avg(v)) END AS value
           FROM obs GROUP BY 1, 2, 3),
    b AS MATERIALIZED (SELECT b0.*, term_idx FROM b0 JOIN terms USING (term)),
    tb AS MATERIALIZED ({_track_union(tracks, True)}),
    runs AS MATERIALIZED (SELECT *, max(idx) OVER (PARTITION BY track, channel, term, grp) AS run_last
             FROM (SELECT *, idx - row_number() OVER
                     (PARTITION BY track, channel, term ORDER BY idx) AS grp FROM tb)),
    conds(seq_len, pred_len) AS (VALUES {conds}),
    win AS MATERIALIZED (SELECT track, channel, term, {fold} AS fold, seq_len, pred_len, idx AS s
            FROM runs, conds WHERE idx + seq_len + pred_len - 1 <= run_last),
    inp AS MATERIALIZED (SELECT w.track, w.channel, w.term, w.seq_len, w.pred_len, w.s, avg(x.value) AS lvl
            FROM win w JOIN (SELECT unnest(generate_series(0, 15)) AS o) o ON o.o < w.seq_len
            JOIN tb x ON x.track = w.track AND x.channel = w.channel
              AND x.term = w.term AND x.idx = w.s + o.o
            GROUP BY ALL),
    leads AS (SELECT w.*, i.lvl, h.h FROM win w
              JOIN inp i USING (track, channel, term, seq_len, pred_len, s)
              JOIN (SELECT unnest(generate_series(0, 15)) AS h) h ON h.h < w.pred_len),
    tbk AS MATERIALIZED (SELECT concat_ws('|', track, channel, term, idx) AS k, value FROM tb),
    vals AS MATERIALIZED (
      SELECT l.*, y.value AS yv, a.value AS lastv, p.value AS prevv FROM leads l
      JOIN tbk y ON y.k = concat_ws('|', track, channel, term, s + seq_len + h)
      JOIN tbk a ON a.k = concat_ws('|', track, channel, term, s + seq_len - 1)
      JOIN tbk p ON p.k = concat_ws('|', track, channel, term, s + seq_len + h - pred_len)),
    pred AS MATERIALIZED (SELECT track, seq_len, pred_len, fold, 'direct' AS strategy, m.model, channel,
                    s + seq_len AS fs, h AS lead,
                    CAST(CASE m.model WHEN 'persistence' THEN lastv WHEN 'repeat' THEN prevv
                         ELSE lvl END AS REAL) AS p, CAST(yv AS REAL) AS y
             FROM vals, (VALUES ('persistence'), ('repeat'), ('level')) m(model))"""


RUN = "track, seq_len, pred_len, fold, strategy, model"

ORDER_PRED_SQL = predictions_sql(ORDER_OBS, DAY_MIN, TRACKS, CONDITIONS, N_FOLD)
EVENT_PRED_SQL = predictions_sql(EVENT_OBS, HOUR_MIN, EVENT_TRACKS, EVENT_CONDITIONS, None)


def case_of(values: dict[str, float], wrap: str = "{}") -> str:
    whens = " ".join(f"WHEN '{k}' THEN {wrap.format(v)}" for k, v in values.items())
    return f"CASE channel {whens} END"


SCORE_SQL = {
    "tss": "CASE WHEN tp+fn > 0 AND fp+tn > 0 THEN tp*1.0/(tp+fn) - fp*1.0/(fp+tn) END",
    "hss": ("CASE WHEN (tp+fn)*(fn+tn)+(tp+fp)*(fp+tn) > 0 THEN "
            "2.0*(tp*tn-fp*fn)/((tp+fn)*(fn+tn)+(tp+fp)*(fp+tn)) END"),
    "pod": "CASE WHEN tp+fn > 0 THEN tp*1.0/(tp+fn) END",
    "far": "CASE WHEN tp+fp > 0 THEN fp*1.0/(tp+fp) END",
    "csi": "CASE WHEN tp+fp+fn > 0 THEN tp*1.0/(tp+fp+fn) END",
    "f1": "CASE WHEN 2*tp+fp+fn > 0 THEN 2.0*tp/(2*tp+fp+fn) END",
    "seds": ("CASE WHEN tp > 0 AND tp < tp+fp+fn+tn THEN (ln((tp+fp)*1.0/(tp+fp+fn+tn)) + "
             "ln((tp+fn)*1.0/(tp+fp+fn+tn))) / ln(tp*1.0/(tp+fp+fn+tn)) - 1 END"),
    "sedi": ("CASE WHEN least(tp,fp,fn,tn) > 0 THEN "
             "(ln(fp*1.0/(fp+tn)) - ln(tp*1.0/(tp+fn)) - ln(tn*1.0/(fp+tn)) + ln(fn*1.0/(tp+fn)))"
             " / (ln(fp*1.0/(fp+tn)) + ln(tp*1.0/(tp+fn)) + ln(tn*1.0/(fp+tn)) "
             "+ ln(fn*1.0/(tp+fn))) END"),
}


def masters_sql(pred_ctes: str, thresholds: dict, hours: int, minutes: int) -> str:
    """CTE list ending in ``reg`` and ``evt`` (unrounded master tables)."""
    gap = hours * 60 // minutes
    scores = ", ".join(f"{e} AS {n}" for n, e in SCORE_SQL.items())
    return f"""{pred_ctes},
    lab AS MATERIALIZED (SELECT *, {case_of(thresholds)} AS threshold,
                   CAST({case_of(thresholds, 'log10({})')} AS REAL) AS thr FROM pred),
    reg0 AS MATERIALIZED (SELECT {RUN}, channel, count(*) AS n,
                 sqrt(avg((p::DOUBLE-y)*(p::DOUBLE-y))) AS rmse, avg(abs(p::DOUBLE-y)) AS mae,
                 median(abs(p::DOUBLE-y)) AS mabs, median(p::DOUBLE-y) AS md,
                 CASE WHEN min(p) < max(p) AND min(y) < max(y)
                      THEN corr(p::DOUBLE, y::DOUBLE) END AS logr
             FROM lab GROUP BY {RUN}, channel),
    reg AS (SELECT {RUN}, channel, n, rmse, mae, 100*(10**mabs - 1) AS msa,
                   sign(md)*100*(10**abs(md) - 1) AS sspb, logr FROM reg0),
    w AS MATERIALIZED (SELECT {RUN}, channel, threshold, fs, max(p) >= max(thr) AS ep, max(y) >= max(thr) AS ey
          FROM lab GROUP BY {RUN}, channel, threshold, fs),
    cells AS MATERIALIZED (SELECT DISTINCT {RUN}, fs FROM pred),
    nxt AS MATERIALIZED (SELECT a.*, n.fs AS nfs FROM cells a ASOF LEFT JOIN cells n
            ON a.track = n.track AND a.seq_len = n.seq_len AND a.pred_len = n.pred_len
            AND a.fold = n.fold AND a.strategy = n.strategy AND a.model = n.model AND a.fs + {gap} <= n.fs),
    kept AS (WITH RECURSIVE k AS (
               SELECT {RUN}, min(fs) AS fs FROM cells GROUP BY ALL
               UNION ALL
               SELECT {RUN}, x.nfs FROM k JOIN nxt x
                 USING ({RUN}, fs) WHERE x.nfs IS NOT NULL)
             SELECT * FROM k),
    units AS MATERIALIZED (
      SELECT {RUN}, channel, threshold, 'point' AS granularity, p >= thr AS ep, y >= thr AS ey FROM lab
      UNION ALL
      SELECT {RUN}, channel, threshold, 'window', ep, ey FROM w
      UNION ALL
      SELECT {RUN}, channel, threshold, 'day', ep, ey
      FROM w SEMI JOIN kept USING ({RUN}, fs)),
    cnt AS MATERIALIZED (SELECT {RUN}, channel, granularity, threshold, count(*) AS n,
                   count_if(ey) AS n_events, count_if(ep AND ey) AS tp,
                   count_if(ep AND NOT ey) AS fp, count_if(NOT ep AND ey) AS fn,
                   count_if(NOT ep AND NOT ey) AS tn, 0 AS n_nonfinite
            FROM units GROUP BY {RUN}, channel, granularity, threshold),
    evt AS (SELECT *, {scores} FROM cnt)"""


ORDER_MASTERS_SQL = masters_sql(ORDER_PRED_SQL, THRESHOLDS, CUT_HOURS, DAY_MIN)
EVENT_MASTERS_SQL = masters_sql(EVENT_PRED_SQL, EVENT_THRESHOLDS, 24, HOUR_MIN)


def score_list(names=tuple(SCORE_SQL)) -> str:
    return ", ".join(r(n, n) for n in names)
