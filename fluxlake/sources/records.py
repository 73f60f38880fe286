"""Stored predictions, result records, manifests and report tables.

Every sink writes through Spark's commit protocol (files appear only when the job commits), and
upserts go to a new folder that is swapped in by name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxlake.functions.registry import CELL_KEYS, RECORD_FORMAT, RUN_KEYS
from fluxlake.operators.evaluate import check_predictions
from fluxlake.operators.intervals import DESIGNATION_COLUMNS
from fluxlake.sources.archive import basename

PARTITIONS = ["track", "seq_len", "pred_len"]


def write_predictions(pred: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One row per window and channel, partitioned by condition, so a re-score prunes folders."""
    (check_predictions(pred).write.mode(mode).option("compression", "snappy")
     .partitionBy(*PARTITIONS).parquet(path))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("fold", F.col("fold").cast("int"))


def to_records(regression: DataFrame, event: DataFrame, keys: list[str] = RUN_KEYS) -> DataFrame:
    """Nested result records, one per run; a run has one row per channel and unit."""
    def nested(rows: DataFrame, name: str, drop: list[str]) -> DataFrame:
        cols = [c for c in rows.columns if c not in drop]
        return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    loss = regression.groupBy(*keys).agg(F.max("best_val_loss").alias("best_val_loss"))
    return (loss.join(nested(regression, "regression", [*keys, "best_val_loss"]), keys)
            .join(nested(event, "event", keys), keys, "left")
            .withColumn("format", F.lit(RECORD_FORMAT)))


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").partitionBy(*CELL_KEYS).json(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of the current format. The schema is given, so nothing is inferred."""
    return spark.read.schema(schema).json(path)


def read_manifest(spark: SparkSession, path: str, schema: T.StructType,
                  key: str = "local_path") -> DataFrame:
    """JSON lines; malformed lines are skipped and the last record of a key wins.

    Line order is (file name, file block, position in the block).
    """
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = (spark.read.schema(full).option("columnNameOfCorruptRecord", "_bad").json(path)
             .select("*", F.struct("_metadata.file_name", "_metadata.file_block_start",
                                   F.monotonically_increasing_id()).alias("_line")))
    cols = [f.name for f in schema.fields]
    good = lines.filter(F.col("_bad").isNull() & F.col(key).isNotNull())
    return (good.groupBy(key).agg(F.max_by(F.struct(*cols), "_line").alias("_r"))
            .select("_r.*"))


def upsert_manifest(old: DataFrame, new: DataFrame, key: str = "local_path") -> DataFrame:
    """New records replace old ones with the same key."""
    both = (old.withColumn("_new", F.lit(0))
            .unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True))
    cols = [c for c in both.columns if c != "_new"]
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), "_new").alias("_r")).select("_r.*")


def write_manifest(records: DataFrame, path: str) -> None:
    records.write.mode("errorifexists").json(path)


POINTER = "CURRENT"


def commit_manifest(records: DataFrame, path: str) -> str:
    """Write ``records`` as a new version of the manifest under ``path`` and make it the current one; its name.

    The version is complete in a folder of its own before a pointer file is renamed over the old one, which is one
    step of the file system: readers see the old version or the new one, and what a crash leaves behind is never read.
    """
    spark = records.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    records.write.mode("errorifexists").json(f"{path}/{version}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    staged, final = (hadoop.Path(f"{path}/{name}") for name in (f"{POINTER}-{version}", POINTER))
    out = staged.getFileSystem(conf).create(staged, True)
    out.write(bytearray(version.encode()))
    out.close()
    over = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(over, 1)
    options[0] = over.OVERWRITE
    hadoop.FileContext.getFileContext(final.toUri(), conf).rename(staged, final, options)
    return version


def current_version(spark: SparkSession, path: str) -> str | None:
    """Name of the version that the pointer names; None before the first commit."""
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    if not pointer.getFileSystem(spark._jsc.hadoopConfiguration()).exists(pointer):
        return None
    return spark.read.text(f"{path}/{POINTER}").first()[0]


def current_manifest(spark: SparkSession, path: str, schema: T.StructType, key: str = "local_path") -> DataFrame:
    """The committed records; an empty table before the first commit."""
    version = current_version(spark, path)
    if version is None:
        return spark.createDataFrame([], schema)
    return read_manifest(spark, f"{path}/{version}", schema, key)


def commit_upsert(spark: SparkSession, path: str, new: DataFrame, schema: T.StructType, key: str = "local_path") -> str:
    """Commit the current records with those of ``new`` in place of the ones of the same key."""
    old = current_manifest(spark, path, schema, key)
    return commit_manifest(upsert_manifest(old, new, key).select(*[f.name for f in schema.fields]), path)


def drop_versions(spark: SparkSession, path: str) -> int:
    """Delete versions and staged pointers that are not current, once no reader needs them."""
    keep = current_version(spark, path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system, dropped = root.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for status in system.listStatus(root):
        name = status.getPath().getName()
        if name not in (keep, POINTER) and name.startswith(("version-", f"{POINTER}-")):
            dropped += system.delete(status.getPath(), True)
    return dropped


def first_by_basename(manifest: DataFrame, order: str, value: str,
                      path: str = "local_path") -> DataFrame:
    """First non-empty ``value`` per file name, in the order given."""
    return (manifest.filter(F.col(value).isNotNull() & (F.col(value) != ""))
            .groupBy(basename(path).alias("name"))
            .agg(F.min_by(value, order).alias(value)))


def read_designation(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in DESIGNATION_COLUMNS])
    return spark.read.schema(schema).option("header", True).csv(path)


def write_designation(table: DataFrame, path: str) -> None:
    """A designation table in its fixed column order, as one sorted CSV file (a few hundred rows)."""
    (table.select(*DESIGNATION_COLUMNS).orderBy("start_utc").coalesce(1)
     .write.mode("overwrite").option("header", True).csv(path))


SNAPSHOT = T.StructType([
    T.StructField("time_tag", T.StringType()),
    T.StructField("protons", T.StructType([T.StructField("primary", T.LongType()),
                                           T.StructField("secondary", T.LongType())])),
])


def read_snapshot(spark: SparkSession, pattern: str) -> DataFrame:
    """Current designation row of the newest snapshot file (by name); missing keys are an error."""
    rows = (spark.read.schema(SNAPSHOT).option("multiLine", True).json(pattern)
            .select("*", F.col("_metadata.file_name").alias("_file"),
                    F.monotonically_increasing_id().alias("_pos")))
    # the newest file, and in it the first element
    newest = rows.groupBy("_file").agg(F.min_by(F.struct("time_tag", "protons"), "_pos").alias("_r"))
    top = newest.agg(F.max_by("_r", "_file").alias("_r")).select("_r.*")
    need = lambda c: F.coalesce(F.col(c).cast("string"), F.raise_error(
        F.lit(f"snapshot has no {c}")))
    start = F.date_format(F.coalesce(F.try_to_timestamp("time_tag"), F.raise_error(
        F.lit("snapshot has no usable time_tag")).cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return top.select(
        start.alias("start_utc"), F.lit("open").alias("end_utc"), F.lit("proton").alias("instrument"),
        need("protons.primary").alias("primary_sat"), need("protons.secondary").alias("secondary_sat"))


def write_report(df: DataFrame, path: str, order: list[str], single_file: bool = False) -> None:
    """A report table as sorted CSV: a file per range of the order, or a single one on request."""
    ordered = df.orderBy(*[F.col(c).asc_nulls_last() for c in order])
    if single_file:
        ordered = ordered.coalesce(1)
    ordered.write.mode("overwrite").option("header", True).csv(path)
