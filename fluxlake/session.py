"""Session defaults, package shipping and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# SQL settings every fluxlake job relies on; all of them can be set at run time.
SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # binned tables are small in bytes but their ordered steps are CPU-bound: keep them spread
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows may be whole documents: what a Python worker holds at once is bounded by bytes as well
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def build_session(app: str = "fluxlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


_shipped: set[str] = set()
_scratch: list[str] = []


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per Spark application."""
    context = spark.sparkContext
    home = os.path.dirname(os.path.abspath(__file__))
    # imported from an archive, Spark has it already
    if context.applicationId in _shipped or not os.path.isdir(home):
        return
    # executors fetch the archive from here as long as the driver lives
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(
        os.path.join(folder, f"fluxlake-{uuid.uuid4().hex}"), "zip", os.path.dirname(home), os.path.basename(home)))
    _shipped.add(context.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time defaults to a session that somebody else built, and ship the package."""
    ship_package(spark)
    for key, value in SQL_DEFAULTS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, under the cluster's shared checkpoint folder.

    A session without ``spark.checkpoint.dir`` gets a temporary folder in local mode, where driver
    and tasks share a disk, and an error on a cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    path = os.path.join(base, f"fluxlake-{name}-{uuid.uuid4().hex}")
    _scratch.append(path)
    return path


def scratch_mark() -> int:
    """How many intermediate tables there are so far."""
    return len(_scratch)


def drop_scratch(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Delete the intermediate tables made after a mark, once no result that reads them is needed.

    The table that ``keep`` was read from stays.
    """
    kept = [] if keep is None else [p for p in _scratch[since:] if any(p in f for f in keep.inputFiles())]
    paths = [p for p in _scratch[since:] if p not in kept]
    _scratch[since:] = kept
    dropped = 0
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        dropped += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return dropped


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back, which cuts its lineage."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
