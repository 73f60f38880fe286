"""Queries on master tables: leaderboards, intervals, significance, comparison, run grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlake.functions import labels
from fluxlake.functions.metrics import STANDARD
from fluxlake.functions.registry import RUN_KEYS
from fluxlake.operators import board, compare, conditions, significance
from fluxlake.operators.evaluate import evaluate, master_layout
from fluxlake.plans.common import r, rnd, rounded
from fluxlake.plans.runs import (
    CHANNELS, CONDITIONS, CUT_HOURS, N_FOLD, ORDER_MASTERS_SQL, ORDER_PRED_SQL, RUN, THRESHOLDS, TRACKS, case_of,
    order_predictions,
)
from fluxlake.session import materialize

EXCLUDE = [("level", 5)]
CELL4 = ["track", "seq_len", "pred_len", "channel"]
MODELS = ["persistence", "repeat", "level"]
HORIZON_TITLES = {"2": "2 d", "3": "3 d"}
CHANNEL_TITLES = {"F": "Finished", "O": "Open", "P": "Pending"}
MODEL_TITLES = {"persistence": "Persistence", "level": "Level"}


def _masters(spark: SparkSession, d: str, metrics: list[str]):
    return master_layout(evaluate(order_predictions(spark, d), THRESHOLDS, day_hours=CUT_HOURS,
                                  metrics=metrics))


def _reg(spark: SparkSession, d: str) -> DataFrame:
    return _masters(spark, d, ["rmse", "mae"]).regression


def _evt(spark: SparkSession, d: str, metrics=("hss", "tss")) -> DataFrame:
    return _masters(spark, d, list(metrics)).event


def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    m = _masters(spark, d, ["rmse", "mae", "hss", "tss"])
    # the master tables are stored once, as boards are built from stored masters
    regression, events = materialize(m.regression, "regression-master"), materialize(m.event, "event-master")
    reg = board.cell_means(regression, ["rmse", "mae"], EXCLUDE)
    day = events.filter(F.col("granularity") == board.BOARD_UNIT)
    evt = board.cell_means(day, ["hss", "tss"], EXCLUDE).withColumnRenamed("n_rows", "n_day_rows")
    keys = ["track", "pred_len", "channel", "model"]
    cells = reg.join(evt, keys, "full_outer")
    order = board.board(reg, {t: c[0] for t, c in TRACKS.items()})
    out = cells.join(order, ["track", "pred_len", "model"]).withColumn(
        "best_rmse", board.best_of("rmse", ["track", "pred_len", "channel"]).cast("int"))
    return rounded(out, ["rmse", "mae", "hss", "tss"])


def leaderboard_pivot(spark: SparkSession, d: str) -> DataFrame:
    cells = board.cell_means(_reg(spark, d), ["rmse"], [])
    wide = board.pivot_board(cells, "rmse", CHANNELS, [2, 3])
    return rounded(wide, [f"{c}_{h}" for c in CHANNELS for h in (2, 3)])


def _windows(spark: SparkSession, d: str) -> DataFrame:
    """Window scores; the ``repeat`` model lacks a run of each track and one channel."""
    ev = master_layout(evaluate(order_predictions(spark, d), THRESHOLDS, metrics=["hss"], units=["window"]))
    lacking = (F.col("model") == "repeat") & (
        ((F.col("track") == "multi") & (F.col("channel") == "P")) | ((F.col("fold") == 0) & (F.col("seq_len") == 3)))
    return ev.event.filter(~lacking)


def board_display(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(_windows(spark, d), "windows")
    cells = board.on_run_grid(board.cell_means(rows, ["hss"], EXCLUDE), rows, EXCLUDE)
    return cells.select(
        "track", labels.display(F.col("pred_len").cast("string"), HORIZON_TITLES).alias("horizon"),
        labels.display("channel", CHANNEL_TITLES).alias("channel"),
        labels.display("model", MODEL_TITLES).alias("model"),
        labels.score_cell("hss", "hss_defined", "n_grid").alias("cell"))


def run_shortfall(spark: SparkSession, d: str) -> DataFrame:
    reg = conditions.without(_reg(spark, d), EXCLUDE, ["model", "seq_len"])
    return board.shortfall(reg)


def left_out_runs(spark: SparkSession, d: str) -> DataFrame:
    return board.left_out(_reg(spark, d), EXCLUDE)


def master_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two partial master tables joined into one; equals the master of all runs."""
    reg = materialize(_reg(spark, d), "master")
    parts = [reg.filter(F.col("fold") < 2), reg.filter(F.col("fold") >= 2)]
    out = board.merge_masters(parts, STANDARD.regression_columns, [*RUN_KEYS, "channel"])
    return rounded(out.select(*RUN_KEYS, "channel", "n", "rmse", "mae"), ["rmse", "mae"])


def board_order(spark: SparkSession, d: str) -> DataFrame:
    ranked = board.best_first(_evt(spark, d), "hss", ["channel", "granularity"])
    return rounded(ranked.select(*RUN_KEYS, "channel", "granularity", rnd("hss", 9).alias("hss"),
                                 "rank"), ["hss"])


def fold_ci(spark: SparkSession, d: str) -> DataFrame:
    out = board.fold_ci(_evt(spark, d), [*CELL4, "model", "granularity"], ["hss", "tss"])
    return rounded(out, ["hss_mean", "hss_ci", "tss_mean", "tss_ci"])


def _cells(spark: SparkSession, d: str) -> DataFrame:
    ci = board.fold_ci(_reg(spark, d), [*CELL4, "model"], ["rmse"])
    return ci.select(*CELL4, "model", F.col("rmse_mean").alias("rmse"), "rmse_ci")


def champions(spark: SparkSession, d: str) -> DataFrame:
    out = board.champions(_cells(spark, d), CELL4, "rmse", "rmse_ci")
    return rounded(out.withColumn("overlap", F.col("overlap").cast("int")), ["rmse", "rmse_ci", "gap"])


def standings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(board.standings(_cells(spark, d), CELL4, "rmse"), ["avg_rank"])


def wilcoxon_holm(spark: SparkSession, d: str) -> DataFrame:
    means = _reg(spark, d).groupBy(*CELL4, "model").agg(F.avg("rmse").alias("rmse"))
    pairs = significance.paired(means, CELL4, "rmse", "level")
    tests = significance.holm(significance.signed_rank(pairs, higher_better=False))
    return rounded(tests, ["w_plus", "median_diff", "p_value", "holm_p"])


def _legacy(spark: SparkSession, d: str) -> DataFrame:
    return compare.legacy_counts(order_predictions(spark, d), THRESHOLDS)


def legacy_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compare.legacy_scores(_legacy(spark, d)), ["value"])


def flip_bound(spark: SparkSession, d: str) -> DataFrame:
    counts = _legacy(spark, d)
    ranges = compare.flip_range(counts, [*RUN_KEYS, "channel"], ["tss", "hss", "pod", "far"], k=3)
    return rounded(ranges, [c for c in ranges.columns if c.endswith(("_lo", "_hi"))])


def reconcile(spark: SparkSession, d: str) -> DataFrame:
    """An older table that lacks one model's fold 4 and moved a few points, against a recount
    that lacks one condition."""
    counts = materialize(_legacy(spark, d), "legacy")
    moved = F.least(F.col("fold") * 3, F.col("tp"))
    old = counts.filter(~((F.col("model") == "level") & (F.col("fold") == 4))).select(
        *RUN_KEYS, "channel", "n", (F.col("tp") - moved).alias("tp"), "fp",
        (F.col("fn") + moved).alias("fn"), "tn", F.col("_sq"), F.col("_abs"))
    new = counts.filter(~((F.col("seq_len") == 3) & (F.col("pred_len") == 2)
                          & (F.col("model") == "repeat")))
    out = compare.reconcile(compare.legacy_scores(old), compare.legacy_scores(new), new)
    return rounded(out.withColumn("ok", F.col("ok").cast("int")), ["expected", "actual"])


def failing_metrics(spark: SparkSession, d: str) -> DataFrame:
    return compare.failing_by_metric(reconcile(spark, d).withColumn("ok", F.col("ok") == 1))


def count_differences(spark: SparkSession, d: str) -> DataFrame:
    evt = materialize(_evt(spark, d), "events")
    keys = ["track", "seq_len", "pred_len", "fold", "model", "channel", "granularity"]
    published = evt.withColumn("tp", F.col("tp") + F.col("fold")).withColumn("fn", F.col("fn") - 1)
    recount = evt.filter((F.col("granularity") != "day") | (F.col("model") != "repeat"))
    return compare.count_differences(published, recount, keys)


def difference_histogram(spark: SparkSession, d: str) -> DataFrame:
    return compare.largest_difference_histogram(count_differences(spark, d))


def formula_check(spark: SparkSession, d: str) -> DataFrame:
    names = ["tss", "hss", "csi", "sedi"]
    evt = _evt(spark, d, names).filter(F.col("granularity") == "point")
    shift = F.when(F.col("fold") == 3, 0.002).otherwise(0.0)
    pub = evt.select(*RUN_KEYS, "channel", "tp", "fp", "fn", "tn",
                     *[(F.round(m, 3) + shift).alias(f"pub_{m}") for m in names])
    out = compare.formula_check(pub, [*RUN_KEYS, "channel"], names)
    return rounded(out.withColumn("ok", F.col("ok").cast("int")), ["published", "ours"])


def carry_and_missing(spark: SparkSession, d: str) -> DataFrame:
    """Best validation loss carried over from old rows; runs without an old row get NULL."""
    reg = materialize(_reg(spark, d), "master")
    old = reg.filter(F.col("fold") < 4).withColumn("best_val_loss", F.col("mae"))
    out = board.carry_over(reg, old, "best_val_loss")
    return rounded(out.select(*RUN_KEYS, "channel", "best_val_loss"), ["best_val_loss"])


def _grid(spark: SparkSession) -> DataFrame:
    cells = conditions.condition_grid(spark, {
        "track": list(TRACKS), "seq_len": [3, 5, 9], "pred_len": [2, 3],
        "fold": list(range(N_FOLD)), "strategy": ["direct", "recursive"]})
    models = {f"{t}|direct": MODELS for t in TRACKS}
    runs = conditions.with_models(cells, models)
    return conditions.without(runs, EXCLUDE, ["model", "seq_len"])


def run_grid_pending(spark: SparkSession, d: str) -> DataFrame:
    """Grid runs without scored rows and predictions: the ones a sweep would still have to do."""
    pred = order_predictions(spark, d)
    rows = compare.legacy_counts(pred, THRESHOLDS).filter(F.col("fold") != 1)
    return conditions.pending(_grid(spark), rows, pred)


def missing_predictions(spark: SparkSession, d: str) -> DataFrame:
    pred = order_predictions(spark, d)
    return conditions.unscorable(_reg(spark, d), pred.filter(F.col("model") != "repeat"))


def run_shard(spark: SparkSession, d: str) -> DataFrame:
    runs = order_predictions(spark, d).select(*RUN_KEYS).distinct()
    return conditions.shard(runs, RUN_KEYS, 1, 4)


def approved_cells(spark: SparkSession, d: str) -> DataFrame:
    runs = (order_predictions(spark, d).groupBy(*RUN_KEYS).agg(F.count("*").alias("n"))
            .withColumn("position", F.when(F.col("model") == "level", 0)
                        .when(F.col("model") == "repeat", 1).otherwise(2)))
    out = conditions.models_by_cell(runs, "position")
    return out.select(*conditions.CELL, F.array_join("models", ",").alias("models"))


def cell_names(spark: SparkSession, d: str) -> DataFrame:
    runs = order_predictions(spark, d).select(*conditions.CELL).distinct()
    named = runs.select(F.concat(F.lit("bench/"), labels.cell_name(
        *[F.col(c) for c in ("track", "seq_len", "pred_len", "fold", "strategy")])).alias("name"),
        labels.input_length("seq_len", 480).alias("input"))
    return named.select("name", "input", *labels.parse_cell_name("name", tuple(TRACKS)))


# ---- SQL counterparts -------------------------------------------------------------------------

_M = f"WITH {ORDER_MASTERS_SQL}"
_EXC = "NOT (model = 'level' AND seq_len = 5)"
_FIRST = "CASE track WHEN 'uni_b' THEN 'O' WHEN 'uni_c' THEN 'P' ELSE 'F' END"
_T = "CASE {n} WHEN 2 THEN 12.706204736 WHEN 3 THEN 4.302652730 WHEN 4 THEN 3.182446305 WHEN 5 THEN 2.776445105 END"


def _ci(m: str) -> str:
    n = f"count({m})"
    return (f"{r(f'avg({m})', f'{m}_mean')}, "
            f"{r(f'CASE WHEN {n} > 1 THEN stddev_samp({m}) * {_T.format(n=n)} / sqrt({n}) END', f'{m}_ci')}, "
            f"{n} AS {m}_nfold")


_CELLS = f"""cmean AS (SELECT track, seq_len, pred_len, channel, model, avg(rmse) AS rmse,
    stddev_samp(rmse) * {_T.format(n='count(rmse)')} / sqrt(count(rmse)) AS rmse_ci
    FROM reg GROUP BY 1, 2, 3, 4, 5),
    ranked AS (SELECT *, row_number() OVER w AS k, lead(model) OVER w AS runner_up,
      lead(rmse) OVER w AS nr, lead(rmse_ci) OVER w AS nci FROM cmean
      WINDOW w AS (PARTITION BY track, seq_len, pred_len, channel ORDER BY rmse, model))"""
_LEG_SCORES = {
    "tss": "coalesce(tp*1.0/nullif(tp+fn,0), 0) - coalesce(fp*1.0/nullif(fp+tn,0), 0)",
    "hss": ("CASE WHEN tp+fp+fn+tn = 0 THEN 0 ELSE coalesce((tp+tn - ((tp+fn)*(tp+fp)+(tn+fn)*(tn+fp))*1.0/(tp+fp+fn+tn)) "
            "/ nullif((tp+fp+fn+tn) - ((tp+fn)*(tp+fp)+(tn+fn)*(tn+fp))*1.0/(tp+fp+fn+tn), 0), 0) END"),
    "pod": "coalesce(tp*1.0/nullif(tp+fn,0), 0)",
    "far": "coalesce(fp*1.0/nullif(tp+fp,0), 0)",
}
_LEGCNT = f"""{ORDER_PRED_SQL},
    lab AS (SELECT *, CAST({case_of(THRESHOLDS, 'log10({})')} AS REAL) AS thr FROM pred),
    lc AS MATERIALIZED (SELECT {RUN}, channel, count(*) AS n, count_if(p >= thr AND y >= thr) AS tp,
      count_if(p >= thr AND y < thr) AS fp, count_if(p < thr AND y >= thr) AS fn,
      count_if(p < thr AND y < thr) AS tn, sum((p::DOUBLE-y)*(p::DOUBLE-y)) AS sq,
      sum(abs(p::DOUBLE-y)) AS ab FROM lab GROUP BY {RUN}, channel)"""


def _legacy_sql(src: str) -> str:
    events = " UNION ALL ".join(
        f"SELECT {RUN}, '{s}_' || channel AS metric, {e} AS value FROM {src}"
        for s, e in _LEG_SCORES.items())
    return (f"SELECT {RUN}, 'rmse' AS metric, sqrt(sum(sq) / sum(n)) AS value FROM {src} GROUP BY {RUN} "
            f"UNION ALL SELECT {RUN}, 'mae', sum(ab) / sum(n) FROM {src} GROUP BY {RUN} UNION ALL {events}")


def _flips(src: str, k: int) -> str:
    cols = ", ".join(f"min({e}) AS {s}_lo, max({e}) AS {s}_hi" for s, e in _LEG_SCORES.items())
    return (f"SELECT {RUN}, channel, {cols} FROM (SELECT {RUN}, channel, tp + i AS tp, fp + j AS fp, fn - i AS fn, "
            f"tn - j AS tn FROM {src}, (SELECT unnest(generate_series(-{k}, {k})) AS i), "
            f"(SELECT unnest(generate_series(-{k}, {k})) AS j) WHERE abs(i) + abs(j) <= {k} "
            f"AND least(tp + i, fp + j, fn - i, tn - j) >= 0) GROUP BY {RUN}, channel")


_RECON = f"""WITH {_LEGCNT},
    oldc AS (SELECT {RUN}, channel, n, tp - least(fold*3, tp) AS tp, fp, fn + least(fold*3, tp) AS fn, tn, sq, ab
             FROM lc WHERE NOT (model = 'level' AND fold = 4)),
    newc AS (SELECT * FROM lc WHERE NOT (seq_len = 3 AND pred_len = 2 AND model = 'repeat')),
    e AS MATERIALIZED ({_legacy_sql('oldc')}), a AS MATERIALIZED ({_legacy_sql('newc')}),
    fl AS MATERIALIZED ({_flips('newc', 5)}),
    bnd AS ({' UNION ALL '.join(f"SELECT {RUN}, '{s}_' || channel AS metric, {s}_lo AS lo, {s}_hi AS hi FROM fl" for s in _LEG_SCORES)}),
    er AS (SELECT DISTINCT {RUN} FROM e), ar AS (SELECT DISTINCT {RUN} FROM a),
    rec AS (SELECT {RUN}, metric, e.value AS expected, a.value AS actual,
        CASE WHEN metric IN ('rmse', 'mae') THEN abs(a.value - e.value) <= 1e-4 * abs(e.value)
             ELSE e.value BETWEEN lo - 1e-9 AND hi + 1e-9 END AS ok
      FROM a JOIN e USING ({RUN}, metric) LEFT JOIN bnd USING ({RUN}, metric)
      UNION ALL SELECT {RUN}, 'run', 0, 1, false FROM ar ANTI JOIN er USING ({RUN})
      UNION ALL SELECT {RUN}, 'run', 1, 0, false FROM er ANTI JOIN ar USING ({RUN}))"""
_DIFF = f"""{_M}, df AS (SELECT p.track, p.seq_len, p.pred_len, p.fold, p.model, p.channel, p.granularity,
    q.tp - (p.tp + p.fold) AS d_tp, q.fp - p.fp AS d_fp, q.fn - (p.fn - 1) AS d_fn, q.tn - p.tn AS d_tn
    FROM evt p LEFT JOIN (SELECT * FROM evt WHERE granularity <> 'day' OR model <> 'repeat') q
    USING (track, seq_len, pred_len, fold, model, channel, granularity))"""
_GRID = f"""grid AS (SELECT track, CAST(seq_len AS INTEGER) AS seq_len, CAST(pred_len AS INTEGER) AS pred_len,
    CAST(fold AS INTEGER) AS fold, 'direct' AS strategy, model FROM (VALUES ('uni_a'), ('uni_b'), ('uni_c'), ('multi')) t(track),
    (VALUES (3), (5), (9)) s(seq_len), (VALUES (2), (3)) p(pred_len), (SELECT unnest(range({N_FOLD})) AS fold),
    (VALUES ('persistence'), ('repeat'), ('level')) m(model) WHERE {_EXC})"""

QUERIES = {
    "leaderboard": (leaderboard, f"""{_M},
      rc AS (SELECT track, pred_len, channel, model, avg(rmse) AS rmse, count(rmse) AS rmse_defined, avg(mae) AS mae,
             count(mae) AS mae_defined, count(*) AS n_rows FROM reg WHERE {_EXC} GROUP BY 1, 2, 3, 4),
      ec AS (SELECT track, pred_len, channel, model, avg(hss) AS hss, count(hss) AS hss_defined, avg(tss) AS tss,
             count(tss) AS tss_defined, count(*) AS n_day_rows FROM evt WHERE granularity = 'day' AND {_EXC}
             GROUP BY 1, 2, 3, 4),
      pos AS (SELECT track, pred_len, model, row_number() OVER (PARTITION BY track, pred_len
              ORDER BY rmse NULLS LAST, model) AS position FROM rc WHERE channel = {_FIRST})
      SELECT track, pred_len, channel, model, {r('rmse', 'rmse')}, rmse_defined, {r('mae', 'mae')}, mae_defined, n_rows,
        {r('hss', 'hss')}, hss_defined, {r('tss', 'tss')}, tss_defined, n_day_rows, position,
        CAST(abs(rmse - min(rmse) OVER (PARTITION BY track, pred_len, channel)) <= 1e-12 AS INTEGER) AS best_rmse
      FROM rc JOIN ec USING (track, pred_len, channel, model) JOIN pos USING (track, pred_len, model)"""),
    "leaderboard_pivot": (leaderboard_pivot, f"{_M} SELECT track, model, " + ", ".join(
        r(f"avg(CASE WHEN channel = '{c}' AND pred_len = {h} THEN rmse END)") + f' AS "{c}_{h}"'
        for c in CHANNELS for h in (2, 3)) + " FROM reg GROUP BY 1, 2"),
    "board_display": (board_display, f"""{_M}, e AS (SELECT * FROM evt WHERE granularity = 'window' AND {_EXC}
        AND NOT (model = 'repeat' AND ((track = 'multi' AND channel = 'P') OR (fold = 0 AND seq_len = 3)))),
      g AS (SELECT track, pred_len, count(DISTINCT (seq_len, fold)) AS n FROM e GROUP BY 1, 2),
      l AS (SELECT DISTINCT a.track, a.pred_len, a.channel, b.model FROM e a JOIN e b USING (track, pred_len)),
      c AS (SELECT track, pred_len, channel, model, avg(hss) AS hss, count(hss) AS k FROM e GROUP BY 1, 2, 3, 4)
      SELECT track, pred_len || ' d' AS horizon, CASE channel WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE 'Pending' END AS channel,
      CASE model WHEN 'persistence' THEN 'Persistence' WHEN 'level' THEN 'Level' ELSE model END AS model,
      CASE WHEN k IS NULL THEN '--' ELSE coalesce(printf('%.3f', hss), '--') || CASE WHEN k = n THEN '' ELSE
      ' (' || k || '/' || n || ')' END END AS cell
      FROM l JOIN g USING (track, pred_len) LEFT JOIN c USING (track, pred_len, channel, model)"""),
    "run_shortfall": (run_shortfall, f"""{_M}, k AS (SELECT DISTINCT track, pred_len, fold, seq_len, model FROM reg WHERE {_EXC}),
      g AS (SELECT DISTINCT track, pred_len, fold, seq_len FROM k), m AS (SELECT DISTINCT track, pred_len, model FROM k)
      SELECT g.track, g.pred_len, fold, seq_len, model FROM g JOIN m USING (track, pred_len)
      ANTI JOIN k USING (track, pred_len, fold, seq_len, model)"""),
    "left_out_runs": (left_out_runs, f"""{_M} SELECT pred_len, count(DISTINCT ({RUN})) AS n_left_out FROM reg
      WHERE NOT ({_EXC}) GROUP BY 1"""),
    "master_merge": (master_merge, f"{_M} SELECT {RUN}, channel, n, {r('rmse', 'rmse')}, {r('mae', 'mae')} FROM reg"),
    "board_order": (board_order, f"""{_M} SELECT {RUN}, channel, granularity, {r('hss', 'hss')}, row_number() OVER
      (PARTITION BY channel, granularity ORDER BY hss DESC NULLS LAST, {RUN}) AS rank FROM evt"""),
    "fold_ci": (fold_ci, f"""{_M} SELECT track, seq_len, pred_len, channel, model, granularity, {_ci('hss')}, {_ci('tss')}
      FROM evt GROUP BY 1, 2, 3, 4, 5, 6"""),
    "champions": (champions, f"""{_M}, {_CELLS} SELECT track, seq_len, pred_len, channel, model AS champion,
      {r('rmse', 'rmse')}, {r('rmse_ci', 'rmse_ci')}, runner_up, {r('nr - rmse', 'gap')},
      CAST(nr - rmse <= rmse_ci + nci AS INTEGER) AS overlap FROM ranked WHERE k = 1"""),
    "standings": (standings, f"""{_M}, {_CELLS} SELECT model, count_if(k = 1) AS wins, {r('avg(k)', 'avg_rank')},
      count(*) AS n_cells FROM ranked GROUP BY model"""),
    "wilcoxon_holm": (wilcoxon_holm, f"""{_M}, c AS (SELECT track, seq_len, pred_len, channel, model, avg(rmse) AS v
        FROM reg GROUP BY 1, 2, 3, 4, 5),
      d AS (SELECT b.model AS rival, b.v - a.v AS d FROM c a JOIN c b USING (track, seq_len, pred_len, channel)
        WHERE a.model = 'level' AND b.model <> 'level'),
      rk AS MATERIALIZED (SELECT rival, d, rank() OVER (PARTITION BY rival ORDER BY abs(d))
        + (count(*) OVER (PARTITION BY rival, abs(d)) - 1) / 2.0 AS rk,
        row_number() OVER (PARTITION BY rival ORDER BY abs(d)) AS i FROM d WHERE d <> 0),
      t AS (SELECT rival, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w FROM rk GROUP BY 1),
      md AS (SELECT rival, median(d) AS md FROM d GROUP BY 1),
      sub AS (SELECT rival, m, sum(CASE WHEN (m >> (i - 1)) & 1 = 1 THEN rk ELSE 0 END) AS s
        FROM rk, (SELECT unnest(range(65536)) AS m) GROUP BY 1, 2),
      p AS (SELECT rival, n, w, md, count_if(s >= w) / 65536.0 AS p FROM sub JOIN t USING (rival) JOIN md USING (rival)
        GROUP BY 1, 2, 3, 4),
      h AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, rival) + 1) AS sp FROM p)
      SELECT rival, n, {r('w', 'w_plus')}, {r('md', 'median_diff')}, {r('p', 'p_value')},
        {r('least(1.0, max(sp) OVER (ORDER BY p, rival ROWS UNBOUNDED PRECEDING))', 'holm_p')} FROM h"""),
    "legacy_scores": (legacy_scores, f"WITH {_LEGCNT} SELECT {RUN}, metric, {r('value', 'value')} FROM ({_legacy_sql('lc')})"),
    "flip_bound": (flip_bound, f"WITH {_LEGCNT} SELECT {RUN}, channel, " + ", ".join(
        r(f"{s}_{e}", f"{s}_{e}") for s in _LEG_SCORES for e in ("lo", "hi")) + f" FROM ({_flips('lc', 3)})"),
    "reconcile": (reconcile, f"""{_RECON} SELECT {RUN}, metric, {r('expected', 'expected')}, {r('actual', 'actual')},
      CAST(ok AS INTEGER) AS ok FROM rec"""),
    "failing_metrics": (failing_metrics, f"""{_RECON} SELECT metric, count_if(NOT ok) AS n_failing, count(*) AS n_rows
      FROM rec GROUP BY 1"""),
    "count_differences": (count_differences, f"{_DIFF} SELECT * FROM df"),
    "difference_histogram": (difference_histogram, f"""{_DIFF} SELECT CASE WHEN d_tp IS NULL THEN NULL ELSE
      greatest(abs(d_tp), abs(d_fp), abs(d_fn), abs(d_tn)) END AS largest_diff, count(*) AS n_rows FROM df GROUP BY 1"""),
    "formula_check": (formula_check, f"""{_M}, pt AS (SELECT * FROM evt WHERE granularity = 'point'), u AS (
      {' UNION ALL '.join(f"SELECT {RUN}, channel, '{m}' AS metric, round({m}, 3) + CASE WHEN fold = 3 THEN 0.002 ELSE 0.0 END AS pub, {m} AS o FROM pt" for m in ('tss', 'hss', 'csi', 'sedi'))})
      SELECT {RUN}, channel, metric, {r('pub', 'published')}, {r('o', 'ours')}, CAST(CASE WHEN pub IS NULL OR o IS NULL
      THEN pub IS NULL AND o IS NULL ELSE abs(o - pub) <= 5e-4 + 1e-12 END AS INTEGER) AS ok FROM u"""),
    "carry_and_missing": (carry_and_missing, f"""{_M}, o AS (SELECT {RUN}, max(mae) AS l FROM reg WHERE fold < 4 GROUP BY {RUN})
      SELECT {RUN}, channel, {r('l', 'best_val_loss')} FROM reg LEFT JOIN o USING ({RUN})"""),
    "run_grid_pending": (run_grid_pending, f"""WITH {ORDER_PRED_SQL}, {_GRID}, done AS (SELECT DISTINCT {RUN} FROM pred
      WHERE fold <> 1) SELECT {RUN} FROM grid ANTI JOIN done USING ({RUN})"""),
    "missing_predictions": (missing_predictions, f"WITH {ORDER_PRED_SQL} SELECT DISTINCT {RUN} FROM pred WHERE model = 'repeat'"),
    "run_shard": (run_shard, f"""WITH {ORDER_PRED_SQL}, u AS (SELECT *, row_number() OVER (ORDER BY {RUN}) - 1 AS k
      FROM (SELECT DISTINCT {RUN} FROM pred)) SELECT {RUN} FROM u WHERE k % 4 = 1"""),
    "approved_cells": (approved_cells, f"""WITH {ORDER_PRED_SQL} SELECT DISTINCT track, seq_len, pred_len, fold, strategy,
      'level,repeat,persistence' AS models FROM pred"""),
    "cell_names": (cell_names, f"""WITH {ORDER_PRED_SQL} SELECT DISTINCT 'bench/' || track || '_seq' || seq_len || '_pred' ||
      pred_len || '_f' || fold || '_' || strategy AS name, CASE WHEN seq_len * 480 % 1440 = 0 THEN
      (seq_len * 480 // 1440) || '-day' ELSE (seq_len * 8) || '-hour' END AS input, track, seq_len, pred_len, fold, strategy FROM pred"""),
}

__all__ = ["CONDITIONS", "QUERIES", "event_columns"]
