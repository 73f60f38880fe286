"""Incremental forms of binning, deduplication and threshold alerts.

Results are upserted: every micro-batch writes the rows it changed under its number, and reading
takes the newest version of a key, so a table read at any time equals what the batch operator gives
for the samples that have arrived. Now and then the stream compacts what it has written: a generation holds the newest
row of every key up to a batch, and replaces the batches up to its number and the generation before. Event-time watermarks bound the state of open bins; a sample
that is later than the stated delay is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxlake.operators.grid import check_cadence, stored_value
from fluxlake.session import scratch_dir

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sample_stream(spark: SparkSession, folder: str, glob: str, schema: T.StructType, time: str,
                  series: str, value: str, extra: tuple[str, ...] = (), files_per_batch: int | None = None) -> DataFrame:
    """``(time_utc, series, value)`` of arriving Parquet files; zone-less times become UTC."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.parquet(folder)
    v = F.col(value).cast("double")
    return raw.select(F.col(time).cast("timestamp").alias("time_utc"), F.col(series).alias("series"),
                      F.nanvl(v, F.lit(None).cast("double")).alias("value"), *extra)


def incremental_bins(samples: DataFrame, cadence_min: int, delay: str = "10 minutes",
                     min_count: int = 1, transform: str = "none") -> DataFrame:
    """Bin means of arriving samples, written anew whenever a bin changes.

    State is one (sum, count) per bin and series younger than ``delay``, whatever the sample rate.
    """
    check_cadence(cadence_min)
    agg = (samples.withWatermark("time_utc", delay)
           .groupBy(F.window("time_utc", f"{cadence_min} minutes").alias("_w"), "series")
           .agg(F.avg("value").alias("_mean"), F.count("value").alias("n_samples")))
    masked = F.when(F.col("n_samples") >= min_count, F.col("_mean"))
    return agg.select("series", F.col("_w.start").alias("bin_ts"), "n_samples",
                      stored_value(masked, transform).alias("value"))


def last_of_repeats(samples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key of a batch: the one that arrived last. Needs no state."""
    rest = [c for c in samples.columns if c not in keys]
    last = samples.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(*keys, "_r.*")


def alerts(bins: DataFrame, threshold: float) -> DataFrame:
    """Bins at or above the threshold."""
    return bins.filter(F.col("value") >= F.lit(float(threshold)))


def _numbered(spark: SparkSession, out: str) -> dict[str, list[int]]:
    """Numbers of the complete folders of each kind under ``out``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(out)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"batch": [], "generation": []}
    if system.exists(root):
        for status in system.listStatus(root):
            kind, _, number = status.getPath().getName().partition("=")
            if kind in found and system.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found[kind].append(int(number))
    return found


def read_upserted(spark: SparkSession, out: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The newest row of every key: the last generation and the batches after it."""
    found = _numbered(spark, out)
    upto = max(found["generation"], default=-1)
    versions = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))
    paths = [(f"{out}/generation={upto}", upto)] if upto >= 0 else []
    for path, number in [*paths, *((f"{out}/batch={n}", n) for n in sorted(found["batch"]) if n > upto)]:
        versions = versions.unionAll(spark.read.schema(schema).parquet(path).withColumn("batch", F.lit(number).cast("long")))
    return last_of_repeats(versions, keys, ["batch"]).select(*[f.name for f in schema.fields])


def compact(spark: SparkSession, out: str, schema: T.StructType, keys: list[str]) -> int | None:
    """Write a generation of everything so far and delete what it replaces; its number.

    A generation counts once it is complete, so a crash on the way loses nothing; a batch up to its number that
    is run again afterwards is no longer read.
    """
    found = _numbered(spark, out)
    upto, done = max(found["batch"], default=None), max(found["generation"], default=-1)
    if upto is None or upto <= done:
        return None
    read_upserted(spark, out, schema, keys).write.mode("overwrite").parquet(f"{out}/generation={upto}")
    old = [f"batch={n}" for n in found["batch"]] + [f"generation={n}" for n in found["generation"]]
    for name in old:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return upto


def run_available(stream: DataFrame, name: str, keys: list[str], order: list[str] | None = None,
                  out: str | None = None, checkpoint: str | None = None, compact_every: int = 20) -> DataFrame:
    """Process everything that has arrived and read the newest row of every key.

    ``order`` ranks rows of a key inside a batch (last wins). A batch that is run again after a failure
    overwrites its own folder, so nothing is repeated or lost. Every ``compact_every`` batches are compacted between two batches.
    """
    spark = stream.sparkSession
    base = scratch_dir(spark, name)
    out, checkpoint = out or f"{base}/out", checkpoint or f"{base}/checkpoint"

    def upsert(batch: DataFrame, number: int) -> None:
        rows = last_of_repeats(batch, keys, order) if order else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number % compact_every == compact_every - 1:
            compact(batch.sparkSession, out, stream.schema, keys)

    # a query takes its settings when it starts
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, STATE_STORE)
    try:
        query = (stream.writeStream.foreachBatch(upsert).outputMode("update")
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set(setting, before)
    query.awaitTermination()
    return read_upserted(spark, out, stream.schema, keys)
