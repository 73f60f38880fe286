"""Queries on streams, records, set operations and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlake.functions.registry import RUN_KEYS
from fluxlake.operators import board, quality
from fluxlake.operators.evaluate import evaluate, master_layout
from fluxlake.plans.common import EVENT_OBS, bin_start, bins_sql, r, rnd, rounded, stamp, table, ts
from fluxlake.plans.runs import CUT_HOURS, ORDER_MASTERS_SQL, RUN, THRESHOLDS, order_predictions
from fluxlake.session import prepare, scratch_dir
from fluxlake.sources import records
from fluxlake.streaming import bins as stream

CADENCE = 5
# the input is a month of history in any order of files: bins stay open for longer than that
DELAY = "60 days"
ALERT = 40.0


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = prepare(spark).read.parquet(f"{d}/events.parquet").schema
    return stream.sample_stream(spark, d, "events.parquet", schema, "ts", "event_type", "value", ("event_id",))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("series", stamp("bin_ts").alias("bin_ts"), "n_samples", rnd("value").alias("value"))


def _bins(spark: SparkSession, d: str, name: str) -> DataFrame:
    binned = stream.incremental_bins(_stream(spark, d), CADENCE, DELAY)
    return stream.run_available(binned, name, ["series", "bin_ts"])


def stream_bins(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_bins(spark, d, "stream-bins"))


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every sample arrives twice, as from overlapping snapshots, the second time corrected."""
    twice = _stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "value", F.col("value") + F.col("copy"))
    out = stream.run_available(twice, "stream-dedup", ["series", "time_utc"], ["copy", "event_id"])
    return out.select("series", F.unix_micros("time_utc").alias("time_us"), rnd("value").alias("value"))


def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    return _shown(stream.alerts(_bins(spark, d, "stream-alerts"), ALERT))


def record_tables(spark: SparkSession, d: str) -> DataFrame:
    """Master rows nested into records, sent through JSON text and read back; foreign formats
    stay out."""
    m = master_layout(evaluate(order_predictions(spark, d), THRESHOLDS, day_hours=CUT_HOURS,
                               metrics=["rmse", "hss"]))
    nested = records.to_records(m.regression, m.event)
    nested = nested.withColumn("format", F.when(F.col("fold") == 0, 1).otherwise(F.col("format")))
    schema = nested.schema
    text = nested.select(F.to_json(F.struct(*nested.columns)).alias("line"))
    back = text.select(F.from_json("line", schema).alias("r")).select("r.*")
    rows = board.records_to_rows(back, "event", RUN_KEYS)
    return rounded(rows.select(*RUN_KEYS, "channel", "granularity", "n", "tp", "fp", "fn", "tn", "hss"),
                   ["hss"])


def union_missing_columns(spark: SparkSession, d: str) -> DataFrame:
    """Frames with different channels stacked; absent channels are NULL."""
    c = table(spark, d, "customer", ["c_custkey", "c_acctbal", "c_mktsegment"]).select(
        F.lit("customer").alias("src"), F.col("c_custkey").alias("key"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier", ["s_suppkey", "s_acctbal"]).select(
        F.lit("supplier").alias("src"), F.col("s_suppkey").alias("key"),
        F.col("s_acctbal").alias("balance"))
    out = c.unionByName(s, allowMissingColumns=True).withColumn("balance", F.col("balance").cast("float"))
    return rounded(out, ["balance"], 1)


def set_differences(spark: SparkSession, d: str) -> DataFrame:
    """Customers without orders, parts without line items, and the union of the used keys."""
    keys = lambda name, col: table(spark, d, name, [col]).select(F.col(col).alias("key"))
    no_orders = keys("customer", "c_custkey").exceptAll(keys("orders", "o_custkey").distinct())
    unsold = keys("part", "p_partkey").exceptAll(keys("lineitem", "l_partkey").distinct())
    used = keys("orders", "o_custkey").union(keys("lineitem", "l_suppkey")).distinct()
    tag = lambda df, name: df.withColumn("kind", F.lit(name))
    return (tag(no_orders, "no_orders").unionByName(tag(unsold, "unsold"))
            .unionByName(tag(used, "used")))


def retrieval_lookup(spark: SparkSession, d: str) -> DataFrame:
    """First record per file name, as a manifest is searched for a retrieval time."""
    pages = table(spark, d, "pages", ["page_id", "url"]).select(
        "page_id", F.regexp_replace("url", "[?#].*$", "").alias("local_path"),
        F.col("page_id").cast("string").alias("retrieved"))
    return records.first_by_basename(pages, "page_id", "retrieved")


def checksum_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Checksums recorded of copies with CRLF line ends against recomputed ones."""
    docs = table(spark, d, "documents", ["doc_id", "text"])
    recorded = docs.select("doc_id", F.md5(F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("md5"))
    return quality.checksum_mismatches(recorded, docs.select("doc_id", F.md5("text").alias("md5")),
                                       "doc_id", "md5")


def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    """One record per key: records of the newer table replace those of the older one."""
    docs = table(spark, d, "documents", ["doc_id", "lang", "n_chars"])
    old = docs.select(F.col("doc_id").alias("local_path"), F.col("lang").alias("note"),
                      F.col("n_chars").cast("double").alias("n_chars"))
    new = table(spark, d, "labels", ["doc_id", "quality"]).select(
        F.col("doc_id").alias("local_path"), F.concat(F.lit("q"), F.col("quality")).alias("note"))
    return records.upsert_manifest(old, new)


def manifest_commit(spark: SparkSession, d: str) -> DataFrame:
    """The same through two committed versions, with a version in between that was never made current."""
    docs = table(spark, d, "documents", ["doc_id", "lang", "n_chars"])
    old = docs.select(F.col("doc_id").alias("local_path"), F.col("lang").alias("note"),
                      F.col("n_chars").cast("double").alias("n_chars"))
    new = table(spark, d, "labels", ["doc_id", "quality"]).select(
        F.col("doc_id").alias("local_path"), F.concat(F.lit("q"), F.col("quality")).alias("note"))
    root = scratch_dir(spark, "manifest")
    records.commit_upsert(spark, root, old, old.schema)
    records.write_manifest(old.withColumn("note", F.lit("lost")), f"{root}/version-lost")
    records.commit_upsert(spark, root, new, old.schema)
    return records.current_manifest(spark, root, old.schema)


_BINS = (f"SELECT series, {ts(bin_start('idx', CADENCE), 'bin_ts')}, n AS n_samples, {r('value', 'value')} "
         f"FROM ({bins_sql(EVENT_OBS, CADENCE)})")

QUERIES = {
    "stream_bins": (stream_bins, _BINS),
    "stream_dedup": (stream_dedup, (
        f"SELECT series, epoch_us(t) AS time_us, {r('arg_max(v + 1, id)', 'value')} FROM ({EVENT_OBS}) GROUP BY series, t")),
    "stream_alerts": (stream_alerts, _BINS + f" WHERE value >= {ALERT}"),
    "record_tables": (record_tables, (
        f"WITH {ORDER_MASTERS_SQL} SELECT {RUN}, channel, granularity, n, tp, fp, fn, tn, {r('hss', 'hss')} FROM evt WHERE fold <> 0")),
    "union_missing_columns": (union_missing_columns, (
        f"SELECT 'customer' AS src, c_custkey AS key, {r('CAST(c_acctbal AS REAL)', 'balance', 1)}, c_mktsegment AS segment FROM customer "
        f"UNION ALL SELECT 'supplier', s_suppkey, {r('CAST(s_acctbal AS REAL)', None, 1)}, NULL FROM supplier")),
    "set_differences": (set_differences, (
        "(SELECT c_custkey AS key, 'no_orders' AS kind FROM customer EXCEPT SELECT o_custkey, 'no_orders' FROM orders) UNION ALL "
        "(SELECT p_partkey, 'unsold' FROM part EXCEPT SELECT l_partkey, 'unsold' FROM lineitem) UNION ALL "
        "SELECT * FROM (SELECT o_custkey, 'used' FROM orders UNION SELECT l_suppkey, 'used' FROM lineitem)")),
    "retrieval_lookup": (retrieval_lookup, (
        "SELECT regexp_extract(p, '([^/]+)$', 1) AS name, CAST(min(page_id) AS VARCHAR) AS retrieved FROM "
        "(SELECT page_id, regexp_replace(url, '[?#].*$', '') AS p FROM pages) GROUP BY 1")),
    "checksum_mismatches": (checksum_mismatches, (
        "SELECT doc_id, md5(replace(text, chr(10), chr(13) || chr(10))) AS recorded, md5(text) AS actual FROM documents "
        "WHERE contains(text, chr(10))")),
    "manifest_upsert": (manifest_upsert, (
        "SELECT doc_id AS local_path, CASE WHEN quality IS NULL THEN lang ELSE 'q' || quality END AS note, "
        "CAST(CASE WHEN quality IS NULL THEN n_chars END AS DOUBLE) AS n_chars FROM documents FULL JOIN labels USING (doc_id)")),
}
QUERIES["manifest_commit"] = (manifest_commit, QUERIES["manifest_upsert"][1])

