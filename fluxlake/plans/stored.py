"""Queries through storage: tables are written by the library's sinks and read back by its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxlake.functions.registry import RUN_KEYS
from fluxlake.operators import intervals, quality
from fluxlake.operators.evaluate import check_predictions
from fluxlake.plans import labelling
from fluxlake.plans.common import EVENT_OBS, event_obs, r, rnd, rounded, stamp, table, ts
from fluxlake.plans.labelling import LEAD_SHARE, LEADERS_SQL
from fluxlake.plans.runs import ORDER_PRED_SQL, RUN, order_predictions
from fluxlake.session import scratch_dir
from fluxlake.sources import files, observations, records


def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """``orders`` as CSV with a header, types inferred; features are all columns but target and time."""
    orders = table(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"])
    path = f"{scratch_dir(spark, 'csv')}/orders.csv"
    records.write_report(orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")), path, ["o_orderkey", "o_orderdate"])
    back = observations.scan(spark, path)
    features = observations.csv_feature_columns(back, "o_totalprice", "o_orderdate")
    return back.select(*features, rnd("o_totalprice").alias("o_totalprice"), stamp("o_orderdate").alias("o_orderdate"))


def snapshot_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every day leaves a JSON snapshot of its designation; the newest file counts."""
    leaders = labelling._daily_leaders(labelling._samples(spark, d))
    row = F.struct(F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time_tag"), F.struct(
        F.col("primary_sat").cast("long").alias("primary"), F.col("secondary_sat").cast("long").alias("secondary")).alias("protons"))
    named = leaders.select(F.concat(F.lit("instrument-sources-"), F.date_format("start_ts", "yyyyMMdd"), F.lit(".json")).alias("path"),
                           F.to_json(F.array(row)).alias("content"))
    root = scratch_dir(spark, "snapshots")
    files.write_named_files(named, root)
    return records.read_snapshot(spark, f"{root}/*.json")


MANIFEST = T.StructType([T.StructField("local_path", T.StringType()), T.StructField("n_chars", T.LongType())])


def manifest_scan(spark: SparkSession, d: str) -> DataFrame:
    """A line per document, for some a broken one and a later record with a corrected count."""
    docs = table(spark, d, "documents", ["doc_id", "n_chars"])
    record = lambda n: F.to_json(F.struct(F.concat(F.lit("archive/"), F.col("doc_id")).alias("local_path"), n.alias("n_chars")))
    later = F.when(F.col("doc_id") % 3 == 0, record(F.col("n_chars") + 1))
    broken = F.when(F.col("doc_id") % 5 == 0, F.lit('{"local_path": "archive/'))
    lines = docs.select("doc_id", F.posexplode(F.array(record(F.col("n_chars")), broken, later)).alias("k", "line"))
    root = scratch_dir(spark, "lines")
    lines.filter("line IS NOT NULL").orderBy("doc_id", "k").select("line").write.text(root)
    return records.read_manifest(spark, root, MANIFEST)


def designation_scan(spark: SparkSession, d: str) -> DataFrame:
    """The days' leaders as a designation table in CSV; unclear days belong to another instrument."""
    leaders = labelling._daily_leaders(labelling._samples(spark, d))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = leaders.select(
        iso("start_ts").alias("start_utc"), iso(F.col("start_ts") + F.expr("INTERVAL 1 DAY")).alias("end_utc"),
        F.when(F.col("n1") >= LEAD_SHARE * F.col("n2"), "proton").otherwise("xrs").alias("instrument"), "primary_sat", "secondary_sat",
        F.lit("leaders").alias("source"), F.lit("").alias("source_url"), F.lit("").alias("retrieved_utc"))
    root = scratch_dir(spark, "designation")
    records.write_designation(text, root)
    back = intervals.to_intervals(records.read_designation(spark, root))
    return back.select(stamp("start_ts").alias("start_utc"), stamp("end_ts").alias("end_utc"), "primary_sat", "secondary_sat")


def sorted_sink(spark: SparkSession, d: str) -> DataFrame:
    """Samples as Parquet by year, and the rows that come before a larger one in their file: none."""
    root = scratch_dir(spark, "sorted")
    observations.write_sorted(event_obs(spark, d), root)
    back = spark.read.parquet(root).select("year", "time_utc", "series", F.col("_metadata.file_path").alias("file"),
                                           F.monotonically_increasing_id().alias("at"))
    before = F.lag(F.struct("time_utc", "series")).over(Window.partitionBy("file").orderBy("at"))
    return back.withColumn("unsorted", before > F.struct("time_utc", "series")).groupBy("year", "series").agg(
        F.count("*").alias("n"), F.count_if("unsorted").alias("n_unsorted"), stamp(F.min("time_utc")).alias("first_time"),
        stamp(F.max("time_utc")).alias("last_time"))


def stored_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions saved by condition, read back and checked: windows and mean prediction of every run."""
    root = scratch_dir(spark, "predictions")
    records.write_predictions(order_predictions(spark, d), root)
    back = check_predictions(records.read_predictions(spark, root))
    lead = back.select(*RUN_KEYS, "channel", F.size("pred").alias("steps"), F.explode("pred").alias("p"))
    out = lead.groupBy(*RUN_KEYS, "channel").agg(
        (F.count("*") / F.max("steps")).cast("long").alias("n_windows"), F.avg(F.col("p").cast("double")).alias("mean_pred"))
    return rounded(out, ["mean_pred"], 4)


def report_csv(spark: SparkSession, d: str) -> DataFrame:
    """Rows per series and day as a sorted CSV report, written twice over."""
    daily = quality.rows_by(event_obs(spark, d).withColumn("day", F.date_format("time_utc", "yyyyMMdd").cast("int")), ["series", "day"])
    path = f"{scratch_dir(spark, 'report')}/rows.csv"
    records.write_report(daily.withColumn("n_rows", F.lit(0)), path, ["series", "day"])
    records.write_report(daily, path, ["series", "day"], single_file=True)
    return observations.scan(spark, path)


def qc_report(spark: SparkSession, d: str) -> DataFrame:
    """Tables of quality control as CSV files of one report."""
    root = scratch_dir(spark, "qc")
    roles = labelling.qc_roles(spark, d).select(
        F.lit("rows").alias("report"), F.concat_ws("/", "series", "role").alias("entry"), F.col("n_rows").cast("double").alias("value"))
    missing = labelling.qc_missing(spark, d).select(F.lit("missing").alias("report"), F.col("channel").alias("entry"), F.col("missing_share").alias("value"))
    schema = T.StructType([T.StructField("report", T.StringType()), T.StructField("entry", T.StringType()), T.StructField("value", T.DoubleType())])
    back = []
    for name, part in (("roles", roles), ("missing", missing)):
        records.write_report(part, f"{root}/{name}.csv", ["entry"])
        back.append(observations.scan(spark, f"{root}/{name}.csv", schema=schema))
    return rounded(back[0].unionAll(back[1]), ["value"])


QUERIES = {
    "csv_scan": (csv_scan, (
        f"SELECT o_orderkey, o_orderstatus, {r('o_totalprice', 'o_totalprice')}, {ts('o_orderdate', 'o_orderdate')} FROM orders")),
    "snapshot_scan": (snapshot_scan, (
        f"WITH {LEADERS_SQL} SELECT strftime(a, '%Y-%m-%dT%H:%M:%SZ') AS start_utc, 'open' AS end_utc, 'proton' AS instrument, "
        "CAST(p AS VARCHAR) AS primary_sat, CAST(s AS VARCHAR) AS secondary_sat FROM lead ORDER BY a DESC LIMIT 1")),
    "manifest_scan": (manifest_scan, (
        "SELECT 'archive/' || doc_id AS local_path, n_chars + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n_chars FROM documents")),
    "designation_scan": (designation_scan, (
        f"WITH {LEADERS_SQL} SELECT {ts('a', 'start_utc')}, {ts('a + INTERVAL 1 DAY', 'end_utc')}, CAST(p AS VARCHAR) AS primary_sat, "
        f"CAST(s AS VARCHAR) AS secondary_sat FROM lead WHERE n1 >= {LEAD_SHARE} * n2")),
    "sorted_sink": (sorted_sink, (
        f"SELECT CAST(year(t) AS INTEGER) AS year, series, count(*) AS n, 0 AS n_unsorted, {ts('min(t)', 'first_time')}, {ts('max(t)', 'last_time')} "
        f"FROM ({EVENT_OBS}) GROUP BY 1, 2")),
    "stored_predictions": (stored_predictions, (
        f"WITH {ORDER_PRED_SQL} SELECT {RUN}, channel, count(*) // pred_len AS n_windows, {r('avg(p::DOUBLE)', 'mean_pred', 4)} "
        f"FROM pred GROUP BY {RUN}, channel")),
    "report_csv": (report_csv, (
        f"SELECT series, CAST(strftime(t, '%Y%m%d') AS INTEGER) AS day, count(*) AS n_rows FROM ({EVENT_OBS}) GROUP BY 1, 2")),
    "qc_report": (qc_report, (
        f"SELECT 'rows' AS report, concat_ws('/', series, role) AS entry, {r('n_rows', 'value')} FROM ({labelling.QUERIES['qc_roles'][1]}) "
        f"UNION ALL SELECT 'missing', channel, {r('missing_share')} FROM ({labelling.QUERIES['qc_missing'][1]})")),
}
