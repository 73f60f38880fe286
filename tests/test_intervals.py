import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxlake.operators import intervals
from fluxlake.sources import records

COLS = intervals.DESIGNATION_COLUMNS


def table(spark, rows):
    full = [(s, e, i, p, q, "x", "", "") for s, e, i, p, q in rows]
    return spark.createDataFrame(full, ", ".join(f"{c} string" for c in COLS))


GOOD = [("2000-01-01T00:00:00Z", "2001-01-01T00:00:00Z", "proton", "8", "none"),
        ("2001-01-01T00:00:00Z", "open", "proton", "10", "unknown")]


def test_valid_table_round_trips_through_csv(spark, tmp_path):
    t = intervals.validate(table(spark, GOOD))
    records.write_designation(t, str(tmp_path / "d"))
    back = intervals.to_intervals(records.read_designation(spark, str(tmp_path / "d"))).orderBy("start_ts").collect()
    assert [(r.primary_sat, r.end_ts) for r in back] == [("8", datetime(2001, 1, 1)), ("10", None)]


@pytest.mark.parametrize("row,field,value,problem", [
    (0, 1, "2000-06-01T00:00:00Z", "not contiguous"), (0, 1, "open", "open end before"),
    (0, 1, "1999-01-01T00:00:00Z", "not after start"), (0, 3, "7", "primary"), (1, 4, "99", "secondary"),
    (0, 2, "xrs", "instrument"), (0, 3, "none", "primary"), (0, 1, "2001-01-01T00:00:00+09:00", "bad end"),
    (1, 0, "2001-01-01", "bad start")])
def test_violations(spark, row, field, value, problem):
    rows = [list(r) for r in GOOD]
    rows[row][field] = value
    with pytest.raises(ValueError, match=problem):
        intervals.validate(table(spark, rows))


def test_empty_table_is_an_error(spark):
    with pytest.raises(ValueError):
        intervals.validate(table(spark, []))


def spans(spark, rows):
    return spark.createDataFrame([(datetime(2000, 1, a), datetime(2000, 1, b), p) for a, b, p in rows],
                                 "start_ts timestamp, end_ts timestamp, sat string")


def days(df):
    return [(r.start_ts.day, r.end_ts.day, r.sat) for r in df.orderBy("start_ts").collect()]


def test_merge_and_fill(spark):
    cited = spans(spark, [(3, 5, "8"), (5, 7, "8"), (7, 8, "9"), (10, 12, "9")])
    merged = intervals.merge_equal(cited, ["sat"])
    assert days(merged) == [(3, 7, "8"), (7, 8, "9"), (10, 12, "9")]
    at = lambda d: F.lit(datetime(2000, 1, d))
    filled = intervals.fill_unknown(merged, at(1), at(15), ["sat"])
    assert days(filled) == [(1, 3, "unknown"), (3, 7, "8"), (7, 8, "9"), (8, 10, "unknown"),
                            (10, 12, "9"), (12, 15, "unknown")]
    for rows in ([(3, 6, "8"), (5, 7, "9")], [(3, 20, "8")], [(5, 5, "8")]):
        with pytest.raises(Exception, match="overlaps or is out of bounds"):
            intervals.fill_unknown(spans(spark, rows), at(1), at(15), ["sat"]).collect()


def test_roles(spark):
    iv = spark.createDataFrame([(datetime(2000, 1, 2), "8", "9"), (datetime(2000, 1, 4), "9", "unknown")],
                               "start_ts timestamp, primary_sat string, secondary_sat string")
    rows = [("G8", 8, 1), ("G8", 8, 2), ("G8", 8, 5), ("G9", 9, 3), ("G9", 9, 4), ("G9", None, 3), ("Gp", 13, 1),
            ("Gs", 13, 9), ("Gx", 13, 3)]
    df = spark.createDataFrame([(s, n, datetime(2000, 1, d)) for s, n, d in rows],
                               "series string, source_sat short, time_utc timestamp")
    got = [(r.series, r.source_sat, r.time_utc.day, r.role) for r in intervals.assign_roles(df, iv).collect()]
    assert sorted(got, key=str) == sorted([
        ("G8", 8, 1, "other"), ("G8", 8, 2, "primary"), ("G8", 8, 5, "other"), ("G9", 9, 3, "secondary"),
        ("G9", 9, 4, "primary"), ("G9", None, 3, "other"), ("Gp", 13, 1, "primary"), ("Gs", 13, 9, "secondary"),
        ("Gx", 13, 3, None)], key=str)
    none = intervals.assign_roles(df, None).filter("series = 'G8'").select("role").distinct().collect()
    assert [r.role for r in none] == ["undesignated"]


def test_overlaps_reported_once(spark):
    df = spark.createDataFrame([("a", datetime(2000, 1, 1), datetime(2000, 3, 1)), ("b", datetime(2000, 2, 1), datetime(2000, 4, 1)),
                                ("c", datetime(2000, 3, 1), datetime(2000, 5, 1))], "n string, s timestamp, e timestamp")
    out = intervals.overlapping_spans(df, "n", "s", "e").collect()
    assert sorted((r.left_name, r.right_name) for r in out) == [("a", "b"), ("b", "c")]


def test_many_spans_of_one_range_against_brute_force(spark):
    rng = np.random.default_rng(2)
    start = rng.integers(0, 4000, 400)
    length = np.where(rng.random(400) < 0.05, 3000, rng.integers(0, 60, 400))
    rows = [(f"n{i % 60}", int(s), int(s + n)) for i, (s, n) in enumerate(zip(start, length, strict=True))]
    df = spark.createDataFrame(rows, "n string, s long, e long").select(
        "n", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e")).repartition(3)
    got = [(r.left_name, r.right_name, r.overlap_start.timestamp(), r.overlap_end.timestamp())
           for r in intervals.overlapping_spans(df, "n", "s", "e").collect()]
    zero = datetime(1970, 1, 1).timestamp()
    want = [(min(p[0], q[0]), max(p[0], q[0]), zero + max(p[1], q[1]), zero + min(p[2], q[2]))
            for i, p in enumerate(rows) for q in rows[:i] if p[0] != q[0] and max(p[1], q[1]) < min(p[2], q[2])]
    assert sorted(got) == sorted(want)


def test_short_spans_in_one_slice_cost_their_pairs(spark):
    n = 100_000
    df = spark.range(n).select(F.col("id").cast("string").alias("n"), F.timestamp_millis(F.col("id") * 10).alias("s"),
                               F.timestamp_millis(F.col("id") * 10 + 15).alias("e"))
    assert intervals.overlapping_spans(df, "n", "s", "e").count() == n - 1
    assert intervals.overlapping_spans(df.limit(0), "n", "s", "e").count() == 0


def test_asof_of_two_tables_against_brute_force(spark):
    rng = random.Random(3)
    at = lambda s: datetime(2000, 1, 1) + timedelta(seconds=s)
    key = lambda: rng.choice(["hot"] * 8 + ["a", "b", None])
    left = [(i, key(), at(rng.randrange(300))) for i in range(600)] + [(600, "hot", None), (601, "alone", at(5))]
    left += [(700 + i, "hot", at(100)) for i in range(400)]
    right = [(key(), at(rng.randrange(300)), rng.randrange(50)) for _ in range(400)] + [("hot", None, 1)]
    a = spark.createDataFrame(left, "id long, k string, t timestamp").repartition(5)
    b = spark.createDataFrame(right, "k string, since timestamp, v long").repartition(3)
    for by in (["k"], []):
        out = intervals.asof_join(a, b if by else b.drop("k"), by, "t", "since", ["since", "v"])
        got = sorted((r.id, r.since, r.v) for r in out.collect())
        want = []
        for i, k, t in left:
            ok = [(s, v) for kk, s, v in right if t and s and s <= t and (not by or (k == kk and k is not None))]
            want.append((i, *max(ok, default=(None, None))))
        assert got == sorted(want)
    with pytest.raises(ValueError):
        intervals.asof_join(a, b, ["k"], "t", "since", ["k"])


def test_interval_tables_by_key_in_slices(spark):
    """Sliced by days, two keys and a whole timeline give the same as one timeline each."""
    rows = [("x", 3, 5, "8"), ("x", 5, 7, "8"), ("x", 7, 8, "9"), ("x", 10, 12, "9"), ("y", 2, 4, "8"), (None, 4, 6, "7")]
    cited = spark.createDataFrame([(k, datetime(2000, 1, a), datetime(2000, 1, b), p) for k, a, b, p in rows],
                                  "k string, start_ts timestamp, end_ts timestamp, sat string")
    merged = intervals.merge_equal(cited, ["sat"], ("k",), 86_400)
    bounds = spark.createDataFrame([(k, datetime(2000, 1, 1), datetime(2000, 1, 15)) for k in ("x", "y", "z", None)],
                                   "k string, global_start timestamp, current_start timestamp")
    filled = intervals.fill_unknown_by(merged, bounds, ["sat"], ("k",), 86_400)
    got = {k: days(filled.filter(F.col("k").eqNullSafe(F.lit(k)))) for k in ("x", "y", "z", None)}
    assert got == {
        "x": [(1, 3, "unknown"), (3, 7, "8"), (7, 8, "9"), (8, 10, "unknown"), (10, 12, "9"), (12, 15, "unknown")],
        "y": [(1, 2, "unknown"), (2, 4, "8"), (4, 15, "unknown")], "z": [(1, 15, "unknown")],
        None: [(1, 4, "unknown"), (4, 6, "7"), (6, 15, "unknown")]}
    over = cited.unionByName(cited.filter("k = 'y'").withColumn("start_ts", F.col("start_ts") + F.expr("INTERVAL 1 DAY")))
    with pytest.raises(Exception, match="overlaps or is out of bounds"):
        intervals.fill_unknown_by(over, bounds, ["sat"], ("k",), 86_400).collect()
    ended = intervals.interval_ends(cited.drop("end_ts"), F.lit(datetime(2000, 2, 1)), by=("k",), slice_seconds=86_400)
    assert days(ended.filter("k = 'x'")) == [(3, 5, "8"), (5, 7, "8"), (7, 10, "9"), (10, 1, "9")]


def test_violations_by_key_in_slices(spark):
    bad = [("2000-01-01T00:00:00Z", "2000-06-01T00:00:00Z", "proton", "8", "none"), ("2001-01-01", "open", "proton", "10", "unknown"), GOOD[1]]
    by_key = table(spark, GOOD).withColumn("k", F.lit("good")).unionByName(table(spark, bad).withColumn("k", F.lit("bad")))
    got = sorted(tuple(r) for r in intervals.violations(by_key, ("k",), 86_400).collect())
    alone = sorted(("bad", *r) for r in intervals.violations(table(spark, bad)).collect())
    assert got == alone and {p for _, _, p in got} == {"bad start time", "not contiguous with the next row", "open end before the last row"}
