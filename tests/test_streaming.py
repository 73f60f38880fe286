from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fluxlake.operators.grid import bin_mean
from fluxlake.streaming import bins as stream

T0 = datetime(2024, 1, 1)
SCHEMA = "t timestamp_ntz, s string, v double"


def drop(spark, folder, name, rows):
    spark.createDataFrame([(T0 + timedelta(minutes=m), s, v) for m, s, v in rows], "t timestamp, s string, v double").select(
        F.col("t").cast("timestamp_ntz").alias("t"), "s", "v").coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def open_stream(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    return stream.sample_stream(spark, f"{folder}/*", "*.parquet", schema, "t", "s", "v")


def test_restarted_stream_equals_batch(spark, tmp_path):
    folder, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    first = [(m, "a", float(m)) for m in range(0, 60, 2)]
    second = [(m, "a", float(m)) for m in range(60, 200, 3)] + [(130, "b", float("nan"))]
    drop(spark, folder, "one", first)
    binned = lambda: stream.incremental_bins(open_stream(spark, folder), 5, "10 minutes")
    key = ["series", "bin_ts"]
    stream.run_available(binned(), "t", key, out=out, checkpoint=ckpt)
    drop(spark, folder, "two", second)
    got = stream.run_available(binned(), "t", key, out=out, checkpoint=ckpt)
    rows = spark.createDataFrame([(T0 + timedelta(minutes=m), s, None if v != v else v) for m, s, v in first + second],
                                 "time_utc timestamp, series string, value double")
    want = bin_mean(rows, 5)
    shown = lambda df: sorted((r.series, r.bin_ts, r.n_samples, r.value) for r in df.collect())
    assert shown(got) == shown(want)


def test_of_repeats_across_snapshots_the_last_stays(spark, tmp_path):
    folder, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    keys = ["series", "time_utc"]
    drop(spark, folder, "one", [(m, "a", 1.0) for m in range(10)])
    stream.run_available(open_stream(spark, folder), "t", keys, ["value"], out, ckpt)
    drop(spark, folder, "two", [(m, "a", 2.0) for m in range(5, 15)] + [(14, "a", 3.0)])
    got = stream.run_available(open_stream(spark, folder), "t", keys, ["value"], out, ckpt)
    assert sorted((r.time_utc.minute, r.value) for r in got.collect()) == [
        *((m, 1.0) for m in range(5)), *((m, 2.0) for m in range(5, 14)), (14, 3.0)]


def test_alert_threshold_is_inclusive(spark, tmp_path):
    folder = str(tmp_path / "in")
    drop(spark, folder, "one", [(0, "a", 10.0), (5, "a", 9.9), (10, "a", 12.0), (60, "a", 0.0)])
    bins = stream.run_available(stream.incremental_bins(open_stream(spark, folder), 5), "t", ["series", "bin_ts"])
    got = stream.alerts(bins, 10.0)
    assert sorted(r.value for r in got.collect()) == [10.0, 12.0]


def test_fifty_batches_leave_a_generation_and_a_batch(spark, tmp_path):
    folder, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    many = f"{folder}/many"
    for k in range(50):
        spark.createDataFrame([(T0 + timedelta(minutes=m), "a", float(k)) for m in range(k, 60)], "t timestamp, s string, v double").select(
            F.col("t").cast("timestamp_ntz").alias("t"), "s", "v").coalesce(1).write.mode("append").parquet(many)
    schema = spark.createDataFrame([], SCHEMA).schema
    samples = stream.sample_stream(spark, many, "*.parquet", schema, "t", "s", "v", files_per_batch=1)
    keys = ["series", "time_utc"]
    got = stream.run_available(samples, "t", keys, ["value"], out, ckpt, compact_every=7)
    kept = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert kept == ["batch=49", "generation=48"]
    # files may arrive in any order: a key's row is that of the last batch it was in
    assert got.count() == 60 and {r.value for r in got.filter("time_utc = timestamp'2024-01-01 00:00:00'").collect()} == {0.0}
    # a batch up to the generation that is run again is not read
    spark.createDataFrame([(T0, "a", 99.0)], "time_utc timestamp, series string, value double").write.parquet(f"{out}/batch=3")
    again = stream.read_upserted(spark, out, samples.schema, keys)
    assert again.filter("value = 99").count() == 0 and again.count() == 60
    # what a crash leaves unfinished is not read either
    (tmp_path / "out" / "generation=60").mkdir()
    assert stream.read_upserted(spark, out, samples.schema, keys).count() == 60
    assert stream.compact(spark, out, samples.schema, keys) == 49
    assert stream.read_upserted(spark, out, samples.schema, keys).count() == 60
