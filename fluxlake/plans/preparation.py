"""Queries that turn raw samples into bins, terms, splits, runs and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlake.functions.calendar import calendar_features
from fluxlake.functions.registry import RUN_KEYS
from fluxlake.operators import grid, terms, windows
from fluxlake.operators.evaluate import evaluate
from fluxlake.plans.common import (
    EVENT_CHANNELS, EVENT_OBS, LINE_OBS, ORDER_OBS, bin_start, bins_sql, event_obs, line_obs,
    order_obs, r, rnd, rounded, stamp, table, term_sql, ts,
)
from fluxlake.plans.runs import EVENT_MASTERS_SQL, EVENT_THRESHOLDS, RUN, event_predictions, score_list
from fluxlake.sources.observations import filter_role, filter_years, targets_among

HOUR, FIVE, DAY = 60, 5, 1440
SEQ, PRED = 6, 3
GAP_MIN = 20
LENGTHS = [(h, p) for h in (2, 4, 8, 12) for p in (1, 3)]


def bin_mean_min_count(spark: SparkSession, d: str) -> DataFrame:
    bins = grid.bin_mean(event_obs(spark, d), FIVE, min_count=2, transform="log10")
    return bins.select("series", stamp("bin_ts").alias("bin_ts"), "n_samples",
                       rnd("value").alias("value"))


def align_channels(spark: SparkSession, d: str) -> DataFrame:
    wide = grid.bin_mean_wide(event_obs(spark, d), EVENT_CHANNELS, HOUR, transform="log10")
    return wide.select(stamp("bin_ts").alias("bin_ts"),
                       *[rnd(c).alias(c) for c in EVENT_CHANNELS],
                       grid.all_valid(EVENT_CHANNELS).cast("int").alias("all_valid"))


def outer_join_channels(spark: SparkSession, d: str) -> DataFrame:
    """Alignment of channels that were binned on their own: four hourly ones and one of five minutes."""
    obs = event_obs(spark, d)
    coarse = grid.bin_mean(obs.filter(F.col("series") != "view"), HOUR, transform="log10")
    coarse = coarse.withColumn("bin_idx", F.col("bin_idx") * (HOUR // FIVE))
    fine = grid.bin_mean(obs.filter(F.col("series") == "view"), FIVE, transform="log10")
    wide = grid.align_channels(coarse.unionByName(fine), EVENT_CHANNELS)
    return wide.select(stamp("bin_ts").alias("bin_ts"), *[rnd(c).alias(c) for c in EVENT_CHANNELS])


def term_counts(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_table(line_obs(spark, d)).select("term", "term_idx", "n_rows")


def fold_split(spark: SparkSession, d: str) -> DataFrame:
    splits = terms.fold_splits(terms.term_table(line_obs(spark, d)))
    return rounded(terms.split_totals(splits), ["pct_rows"])


def split_assignment(spark: SparkSession, d: str) -> DataFrame:
    tagged = terms.assign_split(order_obs(spark, d), n_fold=5, fold=2)
    return tagged.select("order_id", "term", "split")


def ratio_split(spark: SparkSession, d: str) -> DataFrame:
    out = terms.ratio_split(event_obs(spark, d), SEQ, PRED, 0.7, 0.1, ["time_utc", "event_id"])
    return out.select("event_id", "window_idx", stamp("forecast_start").alias("forecast_start"),
                      "split")


def dense_term_windows(spark: SparkSession, d: str) -> DataFrame:
    obs = order_obs(spark, d).withColumn("term", terms.term_label("time_utc"))
    out = windows.dense_windows(obs, SEQ, PRED, ["time_utc", "order_id"])
    return out.select("order_id", "term", "window_idx", stamp("forecast_start").alias("forecast_start"))


def _five_minute_samples(spark: SparkSession, d: str) -> DataFrame:
    bins = grid.bin_mean(event_obs(spark, d), FIVE)
    return bins.select("series", F.col("bin_ts").alias("time_utc"), "value", "bin_idx")


def outage_segments(spark: SparkSession, d: str) -> DataFrame:
    segs = grid.segments(event_obs(spark, d), gap_seconds=3600)
    return segs.select("series", "segment", stamp("seg_start").alias("seg_start"),
                       stamp("seg_end").alias("seg_end"))


def segments_regrid(spark: SparkSession, d: str) -> DataFrame:
    out = grid.regrid(_five_minute_samples(spark, d), FIVE, ["bin_idx"], gap_min=GAP_MIN)
    return out.select("series", "segment", stamp("time_utc").alias("time_utc"),
                      rnd("value").alias("value"))


def regrid_gap_report(spark: SparkSession, d: str) -> DataFrame:
    before = _five_minute_samples(spark, d)
    after = grid.regrid(before, FIVE, ["bin_idx"], gap_min=GAP_MIN)
    return grid.gap_report(before, after, FIVE, "value", gap_min=GAP_MIN)


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    bins = grid.bin_mean(event_obs(spark, d), HOUR, transform="log10")
    return (bins.filter(F.col("value").isNotNull())
            .withColumn("term", terms.term_label("bin_ts")))


def islands_run_stats(spark: SparkSession, d: str) -> DataFrame:
    obs = event_obs(spark, d).withColumn("term", terms.term_label("time_utc"))
    span = obs.groupBy("series", "term").agg(
        (F.max(grid.bin_index("time_utc", HOUR)) - F.min(grid.bin_index("time_utc", HOUR)) + 1)
        .alias("n"))
    n_bins = span.groupBy("series").agg(F.sum("n").alias("n_bins"))
    stats = windows.run_stats(windows.run_table(_hourly(spark, d)), n_bins, ["series"], long_run=24)
    return rounded(stats, ["median_run", "p90_run", "valid_pct"])


def window_counts_sweep(spark: SparkSession, d: str) -> DataFrame:
    lengths = [{"seq_len": h, "pred_len": p, "length": h + p} for h, p in LENGTHS]
    return windows.window_counts(windows.run_table(_hourly(spark, d)), lengths, ["series"]).drop(
        "length")


def fold_window_totals(spark: SparkSession, d: str) -> DataFrame:
    obs = order_obs(spark, d)
    bins = (grid.bin_mean(obs, DAY).filter(F.col("value").isNotNull())
            .withColumn("term", terms.term_label("bin_ts")))
    per_term = windows.window_counts(windows.run_table(bins), [{"length": 4}, {"length": 7}], ["term"])
    splits = terms.fold_splits(terms.term_table(obs))
    return (
        splits.join(per_term, "term").groupBy("fold", "length")
        .pivot("split", ["train", "val", "test"]).agg(F.sum("n_windows"))
        .withColumn("total", F.col("train") + F.col("val") + F.col("test"))
    )


def window_starts(spark: SparkSession, d: str) -> DataFrame:
    w = windows.window_starts(_hourly(spark, d), SEQ, PRED)
    return w.select("series", "term", stamp("bin_ts").alias("window_start"),
                    stamp(grid.bin_time("forecast_idx", HOUR)).alias("forecast_start"))


def aligned_window_starts(spark: SparkSession, d: str) -> DataFrame:
    chans = EVENT_CHANNELS
    wide = grid.bin_mean_wide(event_obs(spark, d), chans, HOUR, transform="log10")
    valid = wide.filter(grid.all_valid(chans)).withColumn("term", terms.term_label("bin_ts"))
    w = windows.window_starts(valid, 3, 2, ["term"])
    return w.select("term", stamp("bin_ts").alias("window_start"), *[rnd(c).alias(c) for c in chans])


def window_arrays(spark: SparkSession, d: str) -> DataFrame:
    w = windows.window_arrays(_hourly(spark, d), 4, 2)
    both = w.select("series", "bin_idx", F.posexplode(F.concat("x", "y")).alias("pos", "value"))
    return both.select("series", stamp(grid.bin_time("bin_idx", HOUR)).alias("window_start"), "pos",
                       F.when(F.col("pos") < 4, "x").otherwise("y").alias("part"),
                       rnd("value").alias("value"))


def calendar(spark: SparkSession, d: str) -> DataFrame:
    return event_obs(spark, d).select("event_id", *calendar_features("time_utc"))


def scan_filter_project(spark: SparkSession, d: str) -> DataFrame:
    """Pruned scan, role filter and year range (both pushed to Parquet)."""
    cols = ["o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice"]
    df = table(spark, d, "orders", cols)
    target = targets_among(["o_totalprice"])[0]
    picked = filter_years(filter_role(df, "F", "o_orderstatus"), [1996, 1998], "o_orderdate")
    return (picked.filter(F.col("o_orderdate").isNotNull())
            .select("o_orderkey", stamp("o_orderdate").alias("time_utc"), rnd(target).alias(target)))


def first_rows(spark: SparkSession, d: str) -> DataFrame:
    """Row limit in key order: the first 500 samples of the scan."""
    return scan_filter_project(spark, d).orderBy("o_orderkey").limit(500)


def baseline_skill(spark: SparkSession, d: str, cadence_min: int = HOUR) -> DataFrame:
    names = ["hss", "tss", "pod", "far"]
    rows = evaluate(event_predictions(spark, d, cadence_min), EVENT_THRESHOLDS, metrics=names,
                    units=["window"]).event
    out = rows.filter(F.col("granularity") == "window")
    return rounded(out.select(*RUN_KEYS, "channel", "n", "n_events", "tp", "fp", "fn", "tn", *names),
                   names)


# ---- SQL counterparts -------------------------------------------------------------------------

def _hourly_runs(obs: str = EVENT_OBS, minutes: int = HOUR, transform: str = "log10") -> str:
    return f"""
    obs AS ({obs}),
    hb AS (SELECT series, idx, value, {term_sql(bin_start('idx', minutes))} AS term
           FROM ({bins_sql(obs, minutes, transform)}) WHERE value IS NOT NULL),
    isl AS (SELECT *, idx - row_number() OVER (PARTITION BY series, term ORDER BY idx) AS grp FROM hb),
    runs AS (SELECT series, term, grp, min(idx) AS first_idx, max(idx) AS last_idx,
                    count(*) AS run_len FROM isl GROUP BY 1, 2, 3)"""


_TERMS = (f"terms AS (SELECT {term_sql('t')} AS term, count(*) AS n_rows, "
          "row_number() OVER (ORDER BY {0}) - 1 AS term_idx FROM obs GROUP BY 1)")
TERMS_SQL = _TERMS.format(term_sql("t"))
SPLIT_CASE = ("CASE ((term_idx - fold) % 5 + 5) % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test' "
              "ELSE 'train' END")
_PIVOT = ", ".join(f"max(CASE WHEN series = '{c}' THEN value END) AS {c}" for c in EVENT_CHANNELS)
_SEG = f"""
    s AS (SELECT series, {bin_start('idx', FIVE)} AS t, value FROM ({bins_sql(EVENT_OBS, FIVE)})),
    st AS (SELECT *, lag(t) OVER (PARTITION BY series ORDER BY t) AS pt FROM s),
    sg AS (SELECT *, sum(CASE WHEN t - pt > INTERVAL {GAP_MIN} MINUTE THEN 1 ELSE 0 END)
             OVER (PARTITION BY series ORDER BY t) AS segment FROM st),
    segs AS (SELECT series, CAST(segment AS BIGINT) AS segment, min(t) AS a, max(t) AS b FROM sg GROUP BY 1, 2),
    g AS (SELECT series, segment, unnest(generate_series(a, b, INTERVAL {FIVE} MINUTE)) AS t FROM segs),
    rg AS (SELECT g.series, g.segment, g.t, s.value FROM g LEFT JOIN s USING (series, t))"""

QUERIES = {
    "bin_mean_min_count": (bin_mean_min_count, (
        f"SELECT series, {ts(bin_start('idx', FIVE), 'bin_ts')}, n AS n_samples, "
        f"{r('value', 'value')} FROM ({bins_sql(EVENT_OBS, FIVE, 'log10', 2)})")),
    "align_channels": (align_channels, (
        f"SELECT {ts(bin_start('idx', HOUR), 'bin_ts')}, "
        + ", ".join(f"{r(c)} AS \"{c}\"" for c in EVENT_CHANNELS)
        + f", CAST({' AND '.join(c + ' IS NOT NULL' for c in EVENT_CHANNELS)} AS INTEGER) AS all_valid"
        + f" FROM (SELECT idx, {_PIVOT} FROM ({bins_sql(EVENT_OBS, HOUR, 'log10')}) GROUP BY idx)")),
    "outer_join_channels": (outer_join_channels, (
        f"WITH h AS ({bins_sql(EVENT_OBS, HOUR, 'log10')}), f AS ({bins_sql(EVENT_OBS, FIVE, 'log10')}), "
        "u AS (SELECT series, idx * 12 AS idx, value FROM h WHERE series <> 'view' UNION ALL "
        "SELECT series, idx, value FROM f WHERE series = 'view') "
        f"SELECT {ts(bin_start('idx', FIVE), 'bin_ts')}, "
        + ", ".join(r(f"max(CASE WHEN series = '{c}' THEN value END)") + f' AS "{c}"' for c in EVENT_CHANNELS)
        + " FROM u GROUP BY idx")),
    "term_counts": (term_counts, (
        f"WITH obs AS ({LINE_OBS}), {TERMS_SQL} SELECT term, term_idx, n_rows FROM terms")),
    "fold_split": (fold_split, (
        f"WITH obs AS ({LINE_OBS}), {TERMS_SQL}, "
        f"f AS (SELECT *, {SPLIT_CASE} AS split FROM terms, (SELECT unnest(range(5)) AS fold)) "
        "SELECT CAST(fold AS INTEGER) AS fold, split, count(*) AS n_terms, "
        "CAST(sum(n_rows) AS BIGINT) AS n_rows, "
        f"{r('sum(n_rows) * 100.0 / (SELECT count(*) FROM obs)', 'pct_rows')} FROM f GROUP BY 1, 2")),
    "split_assignment": (split_assignment, (
        f"WITH obs AS ({ORDER_OBS}), {TERMS_SQL} SELECT id AS order_id, term, "
        f"{SPLIT_CASE.replace('fold', '2')} AS split FROM obs JOIN terms ON term = {term_sql('t')}")),
    "ratio_split": (ratio_split, (
        f"WITH o AS (SELECT *, row_number() OVER (ORDER BY t, id) - 1 AS i, count(*) OVER () AS n "
        f"FROM ({EVENT_OBS})), w AS (SELECT *, i - {SEQ} AS k, n - {SEQ + PRED} + 1 AS nw FROM o), "
        "x AS (SELECT *, CAST(floor(nw * 0.7) AS BIGINT) AS te, CAST(floor(nw * 0.1) AS BIGINT) AS va "
        "FROM w WHERE k >= 0 AND k < nw) "
        f"SELECT id AS event_id, k AS window_idx, {ts('t', 'forecast_start')}, CASE WHEN k < te THEN "
        "'train' WHEN k < te + va THEN 'val' ELSE 'test' END AS split FROM x")),
    "dense_term_windows": (dense_term_windows, (
        f"WITH o AS (SELECT id, t, {term_sql('t')} AS term FROM ({ORDER_OBS})), n AS (SELECT *, row_number() OVER "
        "(PARTITION BY term ORDER BY t, id) - 1 AS i, count(*) OVER (PARTITION BY term) AS n FROM o) "
        f"SELECT id AS order_id, term, i - {SEQ} AS window_idx, {ts('t', 'forecast_start')} FROM n "
        f"WHERE i >= {SEQ} AND i + {PRED} <= n")),
    "outage_segments": (outage_segments, (
        f"WITH a AS (SELECT series, t, lag(t) OVER (PARTITION BY series ORDER BY t) AS pt FROM ({EVENT_OBS})), "
        "b AS (SELECT *, sum(CASE WHEN t - pt > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER "
        "(PARTITION BY series ORDER BY t) AS segment FROM a) "
        "SELECT series, CAST(segment AS INTEGER) AS segment, "
        f"{ts('min(t)', 'seg_start')}, {ts('max(t)', 'seg_end')} FROM b GROUP BY series, segment")),
    "segments_regrid": (segments_regrid, (
        f"WITH {_SEG} SELECT series, segment, {ts('t', 'time_utc')}, {r('value', 'value')} FROM rg")),
    "regrid_gap_report": (regrid_gap_report, (
        f"WITH {_SEG}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY series ORDER BY t) AS step FROM rg), "
        "o AS (SELECT series, count(*) AS rows_out, count_if(value IS NULL) AS mo, "
        f"count_if(step <> INTERVAL {FIVE} MINUTE AND step <= INTERVAL {GAP_MIN} MINUTE) AS off_cadence_steps "
        "FROM d GROUP BY 1), i AS (SELECT series, count(*) AS rows_in, count_if(value IS NULL) AS mi "
        "FROM s GROUP BY 1) SELECT series, rows_in, rows_out, mo - mi AS new_gap_rows, off_cadence_steps "
        "FROM o JOIN i USING (series)")),
    "islands_run_stats": (islands_run_stats, (
        f"WITH {_hourly_runs()}, nb AS (SELECT series, CAST(sum(n) AS BIGINT) AS n_bins FROM (SELECT series, "
        f"{term_sql('t')} AS term, max(CAST(floor(epoch(t)/3600) AS BIGINT)) - "
        "min(CAST(floor(epoch(t)/3600) AS BIGINT)) + 1 AS n FROM obs GROUP BY 1, 2) GROUP BY 1) "
        "SELECT series, CAST(sum(run_len) AS BIGINT) AS n_valid, count(*) AS n_runs, "
        f"{r('quantile_cont(run_len, 0.5)', 'median_run')}, {r('quantile_cont(run_len, 0.9)', 'p90_run')}, "
        "max(run_len) AS max_run, count_if(run_len >= 24) AS n_long, n_bins, "
        f"{r('sum(run_len) * 100.0 / n_bins', 'valid_pct')} FROM runs JOIN nb USING (series) "
        "GROUP BY series, n_bins")),
    "window_counts_sweep": (window_counts_sweep, (
        f"WITH {_hourly_runs()} SELECT series, seq_len, pred_len, "
        "CAST(sum(greatest(0, run_len - (seq_len + pred_len) + 1)) AS BIGINT) AS n_windows FROM runs, "
        f"(VALUES {', '.join(str(x) for x in LENGTHS)}) l(seq_len, pred_len) GROUP BY ALL")),
    "fold_window_totals": (fold_window_totals, (
        f"WITH {_hourly_runs(ORDER_OBS, DAY, 'none')}, {TERMS_SQL}, "
        f"f AS (SELECT *, {SPLIT_CASE} AS split FROM terms, (SELECT unnest(range(5)) AS fold)), "
        "w AS (SELECT term, length, sum(greatest(0, run_len - length + 1)) AS nw FROM runs, "
        "(VALUES (4), (7)) l(length) GROUP BY ALL) "
        "SELECT CAST(fold AS INTEGER) AS fold, length, "
        + ", ".join(f"CAST(sum(CASE WHEN split = '{s}' THEN nw END) AS BIGINT) AS {s}"
                    for s in ("train", "val", "test"))
        + ", CAST(sum(nw) AS BIGINT) AS total FROM f JOIN w USING (term) GROUP BY fold, length")),
    "window_starts": (window_starts, (
        f"WITH {_hourly_runs()} SELECT series, term, {ts(bin_start('i.idx', HOUR), 'window_start')}, "
        f"{ts(bin_start(f'i.idx + {SEQ}', HOUR), 'forecast_start')} FROM isl i "
        f"JOIN runs USING (series, term, grp) WHERE i.idx + {SEQ + PRED - 1} <= last_idx")),
    "aligned_window_starts": (aligned_window_starts, (
        f"WITH p AS (SELECT idx, {_PIVOT} FROM ({bins_sql(EVENT_OBS, HOUR, 'log10')}) GROUP BY idx), "
        f"v AS (SELECT *, {term_sql(bin_start('idx', HOUR))} AS term FROM p "
        "WHERE " + " AND ".join(f'"{c}" IS NOT NULL' for c in EVENT_CHANNELS) + "), "
        "w AS (SELECT *, count(*) OVER (PARTITION BY term ORDER BY idx "
        "RANGE BETWEEN CURRENT ROW AND 4 FOLLOWING) AS k FROM v) "
        f"SELECT term, {ts(bin_start('idx', HOUR), 'window_start')}, "
        + ", ".join(r(f'"{c}"') + f' AS "{c}"' for c in EVENT_CHANNELS) + " FROM w WHERE k = 5")),
    "window_arrays": (window_arrays, (
        f"WITH {_hourly_runs()}, w AS (SELECT series, term, grp, i.idx FROM isl i "
        "JOIN runs USING (series, term, grp) WHERE i.idx + 5 <= last_idx), "
        "k AS (SELECT *, idx + pos AS at FROM w, (SELECT CAST(unnest(range(6)) AS INTEGER) AS pos)) "
        f"SELECT k.series, {ts(bin_start('k.idx', HOUR), 'window_start')}, pos, "
        f"CASE WHEN pos < 4 THEN 'x' ELSE 'y' END AS part, {r('hb.value', 'value')} "
        "FROM k JOIN hb ON hb.series = k.series AND hb.term = k.term AND hb.idx = k.at")),
    "calendar": (calendar, (
        "SELECT id AS event_id, month(t) AS month, day(t) AS day, (dayofweek(t) + 6) % 7 AS weekday, "
        f"hour(t) AS hour, minute(t) // 15 AS quarter FROM ({EVENT_OBS})")),
    "scan_filter_project": (scan_filter_project, (
        f"SELECT o_orderkey, {ts('o_orderdate', 'time_utc')}, {r('o_totalprice', 'o_totalprice')} "
        "FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) IN (1996, 1998)")),
    "first_rows": (first_rows, (
        f"SELECT o_orderkey, {ts('o_orderdate', 'time_utc')}, {r('o_totalprice', 'o_totalprice')} "
        "FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) IN (1996, 1998) "
        "ORDER BY o_orderkey LIMIT 500")),
    "baseline_skill": (baseline_skill, (
        f"WITH {EVENT_MASTERS_SQL} SELECT {RUN}, channel, n, n_events, tp, fp, fn, tn, "
        f"{score_list(('hss', 'tss', 'pod', 'far'))} FROM evt WHERE granularity = 'window'")),
}
