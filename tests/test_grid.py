from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxlake.operators import grid, terms, windows
from fluxlake.operators.ordered import keep_one, previous_time, row_index, slice_width, time_slice

T0 = datetime(2003, 3, 1)
HOUR_US = 3_600_000_000


def obs(spark, minutes, values=None, series="s"):
    values = values or [1.0] * len(minutes)
    return spark.createDataFrame([(T0 + timedelta(minutes=m), series, v) for m, v in zip(minutes, values)],
                                 "time_utc timestamp, series string, value double")


def starts(spark, bins_idx, length, keys=("series", "term")):
    df = spark.createDataFrame([("s", "t", int(i), 1.0) for i in bins_idx],
                               "series string, term string, bin_idx long, value double")
    return sorted(r.bin_idx for r in windows.window_starts(df, length - 1, 1).collect())


def test_window_starts_vectors(spark):
    assert starts(spark, range(10), 3) == list(range(8))
    assert starts(spark, [i for i in range(10) if i != 5], 3) == [0, 1, 2, 6, 7]
    assert starts(spark, range(2), 3) == []


def test_window_starts_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    valid = rng.random(400) < 0.8
    for length in (2, 5, 9):
        brute = [i for i in range(400 - length + 1) if valid[i:i + length].all()]
        assert starts(spark, np.nonzero(valid)[0], length) == brute


def test_gap_example(spark):
    bins = grid.bin_mean(obs(spark, [0, 5, 15, 20, 25, 30]), 5).withColumn("term", F.lit("t"))
    first = bins.agg(F.min("bin_idx")).first()[0]
    got = windows.window_starts(bins, 2, 1).collect()
    assert sorted(r.bin_idx - first for r in got) == [3, 4]
    assert all(r.forecast_idx == r.bin_idx + 2 for r in got)


def test_windows_stay_inside_terms(spark):
    rows = [("s", "a", i, 1.0) for i in range(4)] + [("s", "b", i, 1.0) for i in range(4, 8)]
    df = spark.createDataFrame(rows, "series string, term string, bin_idx long, value double")
    assert sorted(r.bin_idx for r in windows.window_starts(df, 2, 1).collect()) == [0, 1, 4, 5]


def test_mean_before_log_and_min_count(spark):
    row = grid.bin_mean(obs(spark, [0, 1], [10.0, 1000.0]), 5, transform="log10").first()
    assert row.value == pytest.approx(np.log10(505))
    row = grid.bin_mean(obs(spark, [0, 1, 2, 3]), 5, min_count=5).first()
    assert row.value is None and row.n_samples == 4
    assert grid.bin_mean(obs(spark, [0], [-3.0]), 5, transform="log10").first().value is None


def test_cadence_must_divide_a_day():
    with pytest.raises(ValueError):
        grid.check_cadence(7)


def test_wide_binning_equals_long(spark):
    both = obs(spark, [0, 1, 7], [1.0, 3.0, 5.0], "a").union(obs(spark, [2, 12], [4.0, 8.0], "b"))
    wide = {r.bin_idx: (r.a, r.b) for r in grid.bin_mean_wide(both, ["a", "b"], 5).collect()}
    aligned = grid.align_channels(grid.bin_mean(both, 5), ["a", "b"])
    assert wide == {r.bin_idx: (r.a, r.b) for r in aligned.collect()}
    assert sorted(wide.values(), key=str) == sorted([(2.0, 4.0), (5.0, None), (None, 8.0)], key=str)


def test_segments_and_regrid(spark):
    minutes = [0, 5, 15, 15 + 2000, 15 + 2005, 15 + 2015, 15 + 2017]
    data = obs(spark, minutes).withColumn("rank", F.lit(0))
    segs = grid.segments(data).orderBy("segment").collect()
    assert [(s.segment, (s.seg_end - s.seg_start).total_seconds() / 60) for s in segs] == [(0, 15), (1, 17)]
    out = grid.regrid(data, 5, ["rank"]).orderBy("time_utc").collect()
    got = [((r.time_utc - T0).total_seconds() / 60, r.value) for r in out]
    assert got == [(0, 1.0), (5, 1.0), (10, None), (15, 1.0), (2015, 1.0), (2020, 1.0), (2025, None), (2030, 1.0)]
    report = grid.gap_report(data, grid.regrid(data, 5, ["rank"]), 5, "value").first()
    assert (report.rows_in, report.rows_out, report.new_gap_rows, report.off_cadence_steps) == (7, 8, 2, 0)


def test_long_segments_expand_in_blocks(spark):
    segs = spark.createDataFrame([("s", 0, T0, T0 + timedelta(minutes=5 * 3000 + 2))],
                                 "series string, segment int, seg_start timestamp, seg_end timestamp")
    times = [r.time_utc for r in grid.grid_points(segs, 5).orderBy("time_utc").collect()]
    assert times == [T0 + timedelta(minutes=5 * i) for i in range(3001)]


def test_sliced_steps_equal_plain_ones(spark):
    rng = np.random.default_rng(4)
    minutes = np.unique(rng.integers(0, 20_000, 500)).tolist()
    data = obs(spark, minutes)
    got = {r.time_utc: r.prev_time for r in previous_time(data, ["series"], width_us=HOUR_US).collect()}
    times = sorted(got)
    assert [got[t] for t in times] == [None, *times[:-1]]
    idx = row_index(data, ["time_utc"], time_slice("time_utc", HOUR_US)).orderBy("time_utc").collect()
    assert [r.row_idx for r in idx] == list(range(len(minutes)))


def test_slice_width_follows_the_densest_minute(spark):
    sparse = obs(spark, range(0, 6000, 60))
    assert slice_width(sparse, ["series"], "time_utc") == 24 * HOUR_US
    burst = obs(spark, [0] * 50 + [60])
    assert slice_width(burst, ["series"], "time_utc", rows=10) == 60_000_000 * 10 // 50


def test_keep_one(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 30)], "k string, o int, v int")
    assert sorted(map(tuple, keep_one(df, ["k"], ["o"]).collect())) == [("a", 2, 20), ("b", 1, 30)]
    assert sorted(map(tuple, keep_one(df, ["k"], ["o"], "first").collect())) == [("a", 1, 10), ("b", 1, 30)]


def test_term_labels(spark):
    df = spark.createDataFrame([("2003-06-30 23:59:00",), ("2003-07-01 00:00:00",)], "t string").select(
        F.col("t").cast("timestamp").alias("t"))
    assert [r[0] for r in df.orderBy("t").select(terms.term_label("t")).collect()] == ["2003-H1", "2003-H2"]
    assert [r[0] for r in df.select(terms.term_label("t", "year")).distinct().collect()] == ["2003"]
    with pytest.raises(ValueError):
        terms.term_label("t", "month")


def test_folds_partition_terms_and_test_each_once(spark):
    table = spark.createDataFrame([(f"t{i:02d}", i, 1) for i in range(57)],
                                  "term string, term_idx int, n_rows int")
    rows = terms.fold_splits(table, 5).collect()
    assert len(rows) == 57 * 5
    tested = sorted(r.term_idx for r in rows if r.split == "test")
    assert tested == list(range(57))
    fold0 = {r.term_idx: r.split for r in rows if r.fold == 0}
    assert fold0[3] == "val" and fold0[4] == "test" and fold0[0] == "train"
    for r in rows:
        if r.split == "test":
            assert (r.term_idx + 1) % 5 == r.fold
    with pytest.raises(ValueError):
        terms.fold_splits(table.limit(3), 5)
    with pytest.raises(ValueError):
        terms.fold_splits(table, 5, [5])


def test_ratio_split(spark):
    data = obs(spark, range(0, 200, 2)).withColumn("id", F.monotonically_increasing_id())
    out = terms.ratio_split(data, 4, 2, 0.7, 0.1, ["time_utc"])
    rows = out.orderBy("window_idx").collect()
    n = 100 - 6 + 1
    assert [r.window_idx for r in rows] == list(range(n))
    assert [r.split for r in rows].count("train") == int(n * 0.7)
    assert [r.split for r in rows].count("val") == int(n * 0.1)
    assert rows[0].forecast_start == T0 + timedelta(minutes=8)
    with pytest.raises(ValueError):
        terms.ratio_split(data.limit(3), 4, 2, 0.7, 0.1, ["time_utc"])


def test_window_counts_equal_starts(spark):
    rng = np.random.default_rng(5)
    idx = np.nonzero(rng.random(300) < 0.85)[0]
    df = spark.createDataFrame([("s", "t", int(i), 1.0) for i in idx],
                               "series string, term string, bin_idx long, value double")
    lengths = [{"length": 3}, {"length": 8}]
    got = {r.length: r.n_windows for r in windows.window_counts(windows.run_table(df), lengths).collect()}
    assert got == {3: len(starts(spark, idx, 3)), 8: len(starts(spark, idx, 8))}
