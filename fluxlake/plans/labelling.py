"""Queries on intervals, roles, text archives, catalogues and quality control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxlake.functions import labels
from fluxlake.operators import grid, intervals, quality
from fluxlake.operators.median import grouped_median
from fluxlake.operators.ordered import keep_one
from fluxlake.plans.common import (
    EVENT_CHANNELS, EVENT_OBS, bin_start, bins_sql, event_obs, order_obs, r, rnd, rounded, stamp,
    table, ts,
)
from fluxlake.session import scratch_dir
from fluxlake.sources import archive, catalogue, files

# event type -> (series name, satellite) for the role queries
SERIES = {"view": ("Gp", 16), "click": ("Gs", 17), "error": ("G8", 8), "purchase": ("G9", 9),
          "signup": ("G10", 10)}
LEAD_SHARE = 1.25
ERA_START = "2024-01-15"


def _mapped(col: str, values: dict) -> F.Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[F.col(col)]


def _samples(spark: SparkSession, d: str) -> DataFrame:
    obs = event_obs(spark, d)
    return obs.select("event_id", "time_utc", "value",
                      _mapped("series", {k: v[0] for k, v in SERIES.items()}).alias("series"),
                      _mapped("series", {k: v[1] for k, v in SERIES.items()}).alias("source_sat"))


def _daily_leaders(samples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per key and day the two busiest per-satellite series, as a designation would list them."""
    daily = (samples.filter(F.col("series").rlike("^G[0-9]"))
             .groupBy(*by, F.date_trunc("day", "time_utc").alias("start_ts"), "source_sat")
             .agg(F.count("*").alias("n")))
    order = Window.partitionBy(*by, "start_ts").orderBy(F.col("n").desc(), "source_sat")
    ranked = daily.withColumn("k", F.row_number().over(order)).filter("k <= 2")
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    return ranked.groupBy(*by, "start_ts").agg(
        pick(1, "source_sat").cast("string").alias("primary_sat"),
        pick(2, "source_sat").cast("string").alias("secondary_sat"),
        pick(1, "n").alias("n1"), pick(2, "n").alias("n2"))


def _merged_intervals(samples: DataFrame) -> DataFrame:
    starts = _daily_leaders(samples).select("start_ts", "primary_sat", "secondary_sat")
    ended = intervals.interval_ends(starts, F.lit(None).cast("timestamp"))
    return intervals.merge_equal(ended, ["primary_sat", "secondary_sat"])


def asof_roles(spark: SparkSession, d: str) -> DataFrame:
    samples = _samples(spark, d)
    out = intervals.assign_roles(samples, _merged_intervals(samples))
    return out.select("event_id", "series", "source_sat", "role")


def asof_by_series(spark: SparkSession, d: str) -> DataFrame:
    """As-of join with a key: the last started hour of the sample's own series, from as many hours as there are."""
    obs = event_obs(spark, d)
    hours = grid.bin_mean(obs, 60).select("series", F.col("bin_ts").alias("start_ts"), F.col("n_samples").alias("hour_n"))
    late = obs.withColumn("time_utc", F.col("time_utc") + F.expr("INTERVAL 90 MINUTES"))
    out = intervals.asof_join(late.select("event_id", "series", "time_utc"), hours, ["series"], "time_utc", "start_ts", ["start_ts", "hour_n"])
    return out.select("event_id", "series", stamp("start_ts").alias("hour_start"), "hour_n")


def regrid_labels(spark: SparkSession, d: str) -> DataFrame:
    """Regular grid whose fill rows carry satellite, era and role like the samples."""
    samples = _samples(spark, d)
    cell = F.timestamp_micros(F.floor(F.unix_micros("time_utc") / 300_000_000) * 300_000_000)
    five = samples.groupBy("series", cell.alias("time_utc")).agg(F.max("source_sat").alias("source_sat"), F.count("*").alias("n"))
    filled = intervals.relabel(grid.regrid(five, 5, ["n"], gap_min=20), _merged_intervals(samples), ERA_START, ("before", "after"))
    return filled.select("series", "segment", stamp("time_utc").alias("time_utc"), F.coalesce("n", F.lit(0)).alias("n"),
                         F.coalesce("source_sat", F.lit(-1)).alias("source_sat"), "era", "role")


def undesignated_roles(spark: SparkSession, d: str) -> DataFrame:
    out = intervals.assign_roles(_samples(spark, d), None)
    return quality.rows_by(out, ["series", "role"])


def asof_lines(spark: SparkSession, d: str) -> DataFrame:
    """As-of join of ``lineitem`` with itself: the supplier's last line that was shipped 30 days or more before."""
    lines = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate"])
    earlier = lines.select("l_suppkey", (F.col("l_shipdate").cast("timestamp") + F.expr("INTERVAL 30 DAYS")).alias("from_ts"),
                           F.col("l_shipdate").alias("earlier_date"), F.col("l_orderkey").alias("earlier_order"),
                           F.col("l_linenumber").alias("earlier_line"))
    out = intervals.asof_join(lines.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp")), earlier, ["l_suppkey"],
                              "l_shipdate", "from_ts", ["earlier_date", "earlier_order", "earlier_line"])
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", stamp("l_shipdate").alias("l_shipdate"),
                      stamp("earlier_date").alias("earlier_date"), "earlier_order", "earlier_line")


SITES = 3
MONTH_SECONDS = 30 * 86_400


def _site_leaders(spark: SparkSession, d: str) -> DataFrame:
    return _daily_leaders(_samples(spark, d).withColumn("site", F.pmod("event_id", F.lit(SITES)).cast("int")), ("site",))


def interval_build(spark: SparkSession, d: str) -> DataFrame:
    """Per site, days with a clear leader are cited; the rest of the site's timeline is ``unknown``."""
    leaders = _site_leaders(spark, d)
    day = F.expr("INTERVAL 1 DAY")
    attrs, by = ["primary_sat", "secondary_sat"], ("site",)
    cited = (leaders.filter(F.col("n1") >= LEAD_SHARE * F.col("n2"))
             .select(*by, "start_ts", (F.col("start_ts") + day).alias("end_ts"), *attrs))
    merged = intervals.merge_equal(cited, attrs, by, MONTH_SECONDS)
    bounds = leaders.groupBy(*by).agg(F.min("start_ts").alias("global_start"), (F.max("start_ts") + day).alias("current_start"))
    filled = intervals.fill_unknown_by(merged, bounds, attrs, by, MONTH_SECONDS)
    return filled.select(*by, stamp("start_ts").alias("start_utc"), stamp("end_ts").alias("end_utc"), *attrs)


def interval_violations(spark: SparkSession, d: str) -> DataFrame:
    """Checks of each site's text table, whose unclear days end a day late or name an unknown satellite."""
    leaders = _site_leaders(spark, d)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    clear = F.col("n1") >= LEAD_SHARE * F.col("n2")
    late = F.col("start_ts") + F.expr("INTERVAL 2 DAYS")
    day = F.col("start_ts") + F.expr("INTERVAL 1 DAY")
    text = leaders.select(
        "site", iso("start_ts").alias("start_utc"), iso(F.when(clear, day).otherwise(late)).alias("end_utc"),
        F.lit("proton").alias("instrument"), "primary_sat",
        F.when(F.col("n2") > 20, "77").otherwise(F.col("secondary_sat")).alias("secondary_sat"))
    return intervals.violations(text, ("site",), MONTH_SECONDS)


def interval_overlaps(spark: SparkSession, d: str) -> DataFrame:
    segs = grid.segments(event_obs(spark, d), gap_seconds=3600)
    out = intervals.overlapping_spans(segs, "series", "seg_start", "seg_end")
    return out.select("left_name", "right_name", stamp("overlap_start").alias("overlap_start"),
                      stamp("overlap_end").alias("overlap_end"))


# ---- text archive -----------------------------------------------------------------------------

# type of event -> name of its files, satellite, layout
ARCHIVED = {"purchase": ("G9", 9, "noaa_0p8"), "signup": ("G10", 10, "noaa_0p8"), "click": ("G8", 8, "noaa_0p6"),
            "view": ("Gp_", 16, "kasi"), "error": ("Gs_", 15, "kasi")}


def _header(satellite: int, layout: str) -> str:
    if layout == "kasi":
        return (f"# Prepared by KASI\n# Source: GOES {satellite}\n:Missing line\n# Missing data: -1.00e+05\n"
                "# YR MO DA HHMM Sat P>1 P>5 P>10 P>30 P>50 P>60 P>100 P>500 E>2")
    electrons = "E>0.8" if layout == "noaa_0p8" else "E>0.6"
    return (f"# Prepared by the archive test\n# Source: GOES-{satellite}\n# Location: W075\n"
            f"# Missing data: -1.00e+05\n# Label: {electrons} means electrons\n"
            "# Modified Julian Day\n# YR MO DA HHMM MJD SOD P>1 P>5 P>10 P>30 P>50 P>100 E E E")


def _archive_files(spark: SparkSession, d: str) -> DataFrame:
    """Daily files of all types, rendered from five-minute bins: at most 288 lines per file.

    Sentinels depend on the sample count of a bin: declared missing value, zero, text.
    """
    bins = grid.bin_mean(event_obs(spark, d), 5)
    of_type = lambda i: F.create_map(*[F.lit(x) for k, v in ARCHIVED.items() for x in (k, v[i])])[F.col("series")]
    token = (F.when(F.col("n_samples") == 1, "-1.00e+05").when(F.col("n_samples") == 2, "0.00")
             .when(F.col("n_samples") >= 5, "bad")
             .otherwise(F.rint(F.col("value") * 100).cast("long").cast("string")))
    hhmm = F.regexp_replace(F.date_format("bin_ts", "HHmm"), "^0+(?=.)", "")
    date = F.date_format("bin_ts", "yyyy MM dd")
    n = F.col("n_samples").cast("string")
    noaa = F.concat_ws(" ", date, hhmm, F.lit("60310 0"), token, n, n, n, n, n, n, n, F.lit("7"))
    kasi = F.concat_ws("  ", date, hhmm, of_type(1).cast("string"), token, n, n)   # short line, kept
    line = F.when(of_type(2) == "kasi", kasi).otherwise(noaa)
    name = F.concat(F.date_format("bin_ts", "yyyyMMdd"), F.lit("_"), of_type(0), F.lit("part_5m.txt"))
    files = (bins.groupBy(F.concat(F.lit("archive/"), name).alias("path"), "series")
             .agg(F.array_sort(F.collect_list(F.struct("bin_idx", line.alias("line")))).alias("l")))
    heads = F.create_map(*[F.lit(x) for k, (_, sat, layout) in ARCHIVED.items() for x in (k, _header(sat, layout))])
    return files.select("path", F.concat_ws("\n", heads[F.col("series")], F.array_join("l.line", "\n")).alias("text"))


def _xray_files(spark: SparkSession, d: str) -> DataFrame:
    """Daily X-ray files of all types from one-minute bins; the second channel has zeros and impossible values."""
    bins = grid.bin_mean(event_obs(spark, d), 1)
    of_type = F.create_map(*[F.lit(x) for k, v in ARCHIVED.items() for x in (k, v[0])])[F.col("series")]
    number = F.concat(F.rint(F.col("value") * 100).cast("long").cast("string"), F.lit("e-6"))
    line = F.concat_ws(" ", F.date_format("bin_ts", "yyyy MM dd HHmm"), F.lit("60310 0"), F.col("n_samples").cast("string"), number)
    name = F.concat(F.date_format("bin_ts", "yyyyMMdd"), F.lit("_"), of_type, F.lit("xr_1m.txt"))
    files = bins.groupBy(name.alias("path")).agg(F.array_sort(F.collect_list(F.struct("bin_idx", line.alias("line")))).alias("l"))
    head = "# Prepared by the archive test\n# Source: GOES-15\n# Modified Julian Day\n# YR MO DA HHMM MJD SOD XS XL"
    return files.select("path", F.concat_ws("\n", F.lit(head), F.array_join("l.line", "\n")).alias("text"))


def archive_files(spark: SparkSession, d: str) -> DataFrame:
    """Both kinds written as files of their own names, found, checked and parsed again: a record per file.

    Beside each day's file of one satellite lie a misfiled one, which is not found, and an empty one; every particle
    file ends in a comment with a byte that is no text.
    """
    particle = _archive_files(spark, d).select(F.regexp_replace("path", "^.*/", "").alias("name"), F.concat(
        F.col("text").cast("binary"), F.unhex(F.lit("0A23FF"))).alias("content"))
    own = F.col("name").rlike("_G9part")
    empty = particle.filter(own).select(F.replace("name", F.lit("_G9part"), F.lit("_G13part")).alias("name"), F.lit(b"").alias("content"))
    astray = particle.filter(own).select(F.replace("name", F.lit("_G9part"), F.lit("_G9xpart")).alias("name"), "content")
    xray = _xray_files(spark, d).select(F.col("path").alias("name"), F.col("text").cast("binary").alias("content"))
    rows = particle.unionAll(empty).unionAll(astray).unionAll(xray)
    root = scratch_dir(spark, "archive")
    files.write_named_files(rows.select(F.concat(F.substring("name", 1, 4), F.lit("/"), "name").alias("path"), "content"), root)
    out = []
    for label, kind, channel in (("particle", archive.PARTICLE, "p_gt5"), ("xray", archive.XRAY, "xrs_long")):
        found = archive.with_headers(archive.as_text(archive.list_files(spark, root, kind)), kind)
        parsed = archive.parse_rows(found, kind)
        if label == "xray":
            parsed = archive.mask_ceiling(parsed, list(kind.channels))
        sums = parsed.groupBy("path").agg(F.sum(F.col(channel).cast("double")).alias("total"))
        seen = archive.provenance(found, parsed, kind).join(sums, "path", "left")
        out.append(seen.select(
            F.lit(label).alias("kind"), archive.basename("path").alias("src_file"), "series", "n_rows", stamp("time_start").alias("time_start"), stamp("time_end").alias("time_end"),
            rnd("total").alias("total"), "note"))
    return out[0].unionAll(out[1])


ARCHIVE_COLS = ["p_gt1", "p_gt5", "p_gt60", "e_gt0p6", "e_gt0p8", "e_gt4"]


def parse_archive_text(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.parse_rows(_archive_files(spark, d), archive.PARTICLE)
    kept = archive.last_per_time(rows)
    return kept.select(stamp("time_utc").alias("time_utc"), "series", "source_sat", "location", "era",
                       *[rnd(c).alias(c) for c in ARCHIVE_COLS], "src_file")


def archive_provenance(spark: SparkSession, d: str) -> DataFrame:
    files = archive.with_headers(_archive_files(spark, d), archive.PARTICLE)
    out = archive.provenance(files, archive.parse_rows(files, archive.PARTICLE), archive.PARTICLE)
    return out.select("path", "series", "format", "source_sat", "n_rows",
                      stamp("time_start").alias("time_start"), stamp("time_end").alias("time_end"),
                      F.array_join("channels", ",").alias("channels"))


def ceiling_mask(spark: SparkSession, d: str) -> DataFrame:
    obs = event_obs(spark, d).withColumn("value", F.nullif("value", F.lit(0.0)))
    out = archive.mask_ceiling(obs, ["value"], ceiling=100.0)
    return rounded(out.groupBy("series").agg(
        F.sum("n_masked").alias("n_masked"), F.max("value").alias("max_kept"),
        F.count("value").alias("n_kept")), ["max_kept"])


# ---- labels and catalogues --------------------------------------------------------------------

def regime_labels(spark: SparkSession, d: str) -> DataFrame:
    cust = table(spark, d, "customer", ["c_custkey", "c_nationkey"]).select(
        F.col("c_custkey").alias("o_custkey"),
        F.concat(F.lit("G"), F.col("c_nationkey").cast("string")).alias("series"))
    orders = table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    sat = labels.satellite_number("series")
    return (orders.join(cust, "o_custkey")
            .select("o_orderkey", "series", sat.alias("sat"),
                    labels.era("o_orderdate", "early", "late", "1998-01-01").alias("era"),
                    labels.regime(sat).alias("regime"),
                    F.array_join(labels.regime_flags(sat), ",").alias("flags"),
                    F.array_join(labels.regime_notes(sat), " ").alias("notes")))


def legacy_names(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue of legacy proton files among names with other instruments, cases, suffixes and endings."""
    orders = table(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate"])
    day = F.date_format("o_orderdate", "yyyyMMdd")
    pick = lambda *words: F.element_at(F.array(*map(F.lit, words)), F.col("o_orderkey").cast("int") % len(words) + 1)
    name = F.concat(F.lit("g"), F.lpad((F.col("o_orderkey") % 8 + 8).cast("string"), 2, "0"), F.lit("_"),
                    pick("eps", "epead_p17ew", "hepad_s2", "magn", "HEPAD", "epead_cpflux", "hepad_ap"), F.lit("_"),
                    F.substring("o_orderpriority", 1, 1), F.lit("m_"), day, F.lit("_"), day,
                    pick("", "_science", "_v1.0", "_science_v2.1.0", "_v"), pick(".nc", ".NC", ".csv"))
    found = catalogue.legacy_proton_catalogue(orders.select(name.alias("filename")).distinct())
    return found.select("filename", "sat", "instrument", "cadence", *[
        F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_day", "last_day")])


def _file_names(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", ["o_orderdate", "o_orderstatus", "o_orderpriority"])
    sat = F.when(F.col("o_orderstatus") == "F", "13").when(
        F.col("o_orderstatus") == "O", "16").otherwise("19")
    version = F.concat_ws("-", F.substring("o_orderpriority", 1, 1), F.month("o_orderdate"),
                          F.dayofmonth("o_orderdate"))
    day = F.date_format("o_orderdate", "yyyyMMdd")
    yearly = F.concat(F.lit("sci_xrsf-l2-avg1m_g"), sat, F.lit("_y"), F.year("o_orderdate"),
                      F.lit("_v"), version, F.lit(".nc"))
    mission = F.concat(F.lit("sci_xrsf-l2-avg1m_g"), sat, F.lit("_s"), day, F.lit("_e"), day,
                       F.lit("_v"), version, F.lit(".nc"))
    return o.select(F.when(F.col("o_orderpriority").startswith("5"), mission).otherwise(yearly)
                    .alias("filename")).distinct()


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    cat = catalogue.without_missions(catalogue.yearly_catalogue(_file_names(spark, d)))
    return catalogue.latest_version(cat, ["sat", "year"])


def latest_file_per_satellite(spark: SparkSession, d: str) -> DataFrame:
    cat = catalogue.yearly_catalogue(_file_names(spark, d)).filter(~F.col("full_mission"))
    return cat.groupBy("sat").agg(F.max("filename").alias("filename"))


def dedup_last(spark: SparkSession, d: str) -> DataFrame:
    obs = event_obs(spark, d).withColumn("hour", F.date_trunc("hour", "time_utc"))
    last = keep_one(obs, ["series", "hour"], ["event_id"], "last")
    return last.select("series", stamp("hour").alias("hour"), "event_id", rnd("value").alias("value"))


def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    obs = event_obs(spark, d).withColumn("hour", F.date_trunc("hour", "time_utc"))
    first = keep_one(obs, ["series", "hour"], ["event_id"], "first")
    return first.select("series", stamp("hour").alias("hour"), "event_id", rnd("value").alias("value"))


def checksums(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", ["doc_id", "text"])
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"),
                       F.octet_length("text").alias("n_bytes"))


def json_summary(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events", ["ts", "event_type", "props"])
    rows = ev.select("event_type", F.col("ts").cast("timestamp").alias("time_utc"),
                     F.from_json("props", "k long").alias("p"))
    out = catalogue.snapshot_summary(rows.withColumn("energy", F.col("p.k")),
                                     ["event_type", "energy"], "time_utc")
    meta = F.to_json(F.struct(F.size("energy").alias("n"), F.array_max("energy").alias("top")))
    return out.select(F.array_join("event_type", ",").alias("series"),
                      F.array_join(F.transform("energy", lambda x: x.cast("string")), ",")
                      .alias("energies"), meta.alias("meta"),
                      stamp("first_time").alias("first_time"), stamp("last_time").alias("last_time"))


# ---- quality control --------------------------------------------------------------------------

def qc_roles(spark: SparkSession, d: str) -> DataFrame:
    samples = _samples(spark, d)
    return quality.rows_by(intervals.assign_roles(samples, _merged_intervals(samples)),
                           ["series", "role"])


def qc_missing(spark: SparkSession, d: str) -> DataFrame:
    wide = grid.bin_mean_wide(event_obs(spark, d), EVENT_CHANNELS, 5)
    return rounded(quality.missing_share(wide, EVENT_CHANNELS), ["missing_share"])


def qc_timeline(spark: SparkSession, d: str) -> DataFrame:
    samples = _samples(spark, d)
    out = quality.timeline(intervals.assign_roles(samples, _merged_intervals(samples)), "source_sat")
    return out.select("source_sat", stamp("first_time").alias("first_time"),
                      stamp("last_time").alias("last_time"), "n_rows")


FILL_RULES = {
    "l_quantity": quality.FillRule(valid_min=5.0, valid_max=45.0),
    "l_discount": quality.FillRule(fill_value=0.05, missing_value=0.1),
    "l_tax": quality.FillRule(fill_value=0.0, valid_max=0.07),
}


def qc_fill_mask(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", ["l_returnflag", *FILL_RULES])
    return rounded(quality.masked_counts(li, FILL_RULES, ["l_returnflag"]), ["masked_fraction"])


def qc_cadence(spark: SparkSession, d: str) -> DataFrame:
    out = quality.cadence_report(event_obs(spark, d), ["series"], "time_utc", "event_id")
    return rounded(out.withColumn("monotonic", F.col("monotonic").cast("int")),
                   ["cadence_s", "max_gap_s", "coverage"])


def qc_rollup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", ["o_orderstatus", "o_orderdate", "o_orderpriority"])
    out = quality.rollup(o, "o_orderstatus", "o_orderdate", ["o_orderpriority"])
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("o_orderstatus", join("years").alias("years"),
                      join("o_orderpriority_set").alias("priorities"),
                      stamp("first_time").alias("first_time"),
                      stamp("last_time").alias("last_time"), "n_rows")


def qc_duplicates(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber"])
    return quality.duplicate_keys(li, ["l_orderkey", "l_linenumber"])


def qc_categories(spark: SparkSession, d: str) -> DataFrame:
    return quality.rows_by(table(spark, d, "orders", ["o_orderpriority"]), ["o_orderpriority"])


def qc_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Labels without a document, and documents without a label."""
    return quality.unmatched(table(spark, d, "labels", ["doc_id"]),
                             table(spark, d, "documents", ["doc_id"]), "doc_id")


def exact_medians(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", ["l_returnflag", "l_linestatus", "l_extendedprice"])
    out = grouped_median(li, ["l_returnflag", "l_linestatus"], "l_extendedprice", "median_price")
    return rounded(out, ["median_price"])


# ---- SQL counterparts -------------------------------------------------------------------------

def _case(values: dict, col: str) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in values.items()) + " END"


SAMPLES_SQL = (f"smp AS (SELECT id, t, v, {_case({k: v[0] for k, v in SERIES.items()}, 'series')} AS series, "
               f"{_case({k: v[1] for k, v in SERIES.items()}, 'series')} AS sat FROM ({EVENT_OBS}))")
LEADERS_SQL = f"""{SAMPLES_SQL},
    daily AS (SELECT date_trunc('day', t) AS a, sat, count(*) AS n FROM smp WHERE series NOT IN ('Gp', 'Gs')
              GROUP BY 1, 2),
    rk AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, sat) AS k FROM daily),
    lead AS (SELECT CAST(a AS TIMESTAMP) AS a, max(CASE WHEN k = 1 THEN sat END) AS p,
                    max(CASE WHEN k = 2 THEN sat END) AS s, max(CASE WHEN k = 1 THEN n END) AS n1,
                    max(CASE WHEN k = 2 THEN n END) AS n2 FROM rk GROUP BY 1)"""
SITE_LEADERS_SQL = f"""{SAMPLES_SQL},
    daily AS (SELECT CAST(id % {SITES} AS INTEGER) AS site, date_trunc('day', t) AS a, sat, count(*) AS n FROM smp
              WHERE series NOT IN ('Gp', 'Gs') GROUP BY 1, 2, 3),
    rk AS (SELECT *, row_number() OVER (PARTITION BY site, a ORDER BY n DESC, sat) AS k FROM daily),
    lead AS (SELECT site, CAST(a AS TIMESTAMP) AS a, max(CASE WHEN k = 1 THEN sat END) AS p,
                    max(CASE WHEN k = 2 THEN sat END) AS s, max(CASE WHEN k = 1 THEN n END) AS n1,
                    max(CASE WHEN k = 2 THEN n END) AS n2 FROM rk GROUP BY 1, 2)"""
ROLES_SQL = f"""{LEADERS_SQL},
    roled AS (SELECT smp.*, CASE WHEN series = 'Gp' THEN 'primary' WHEN series = 'Gs' THEN 'secondary'
              WHEN sat = p THEN 'primary' WHEN sat = s THEN 'secondary' ELSE 'other' END AS role
              FROM smp ASOF LEFT JOIN lead ON smp.t >= lead.a)"""
_B5 = f"b AS (SELECT series, idx, n, value, {bin_start('idx', 5)} AS t FROM ({bins_sql(EVENT_OBS, 5)}))"
_NAMES_SQL = """names AS (SELECT DISTINCT CASE WHEN o_orderpriority LIKE '5%' THEN
    format('sci_xrsf-l2-avg1m_g{}_s{}_e{}_v{}-{}-{}.nc', sat, dy, dy, p, m, d) ELSE
    format('sci_xrsf-l2-avg1m_g{}_y{}_v{}-{}-{}.nc', sat, y, p, m, d) END AS filename,
    CAST(sat AS INTEGER) AS sat, CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE y END AS year, p, m, d
    FROM (SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN '13' WHEN 'O' THEN '16' ELSE '19' END AS sat,
    CAST(strftime(o_orderdate, '%Y%m%d') AS VARCHAR) AS dy, CAST(o_orderpriority[1] AS INTEGER) AS p,
    CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d,
    CAST(year(o_orderdate) AS INTEGER) AS y FROM orders))"""
_DUP = ("SELECT series, strftime(h, '%Y-%m-%d %H:%M:%S') AS hour, {pick}(id, id) AS event_id, "
        + r("{pick}(v, id)", "value") + f" FROM (SELECT *, date_trunc('hour', t) AS h FROM ({EVENT_OBS})) GROUP BY series, h")
_MASK = {
    "l_quantity": "l_quantity < 5 OR l_quantity > 45",
    "l_discount": "abs(l_discount - 0.05) <= 1e-8 + 1e-5*0.05 OR abs(l_discount - 0.1) <= 1e-8 + 1e-5*0.1",
    "l_tax": "abs(l_tax) <= 1e-8 OR l_tax > 0.07",
}
_FILE, _SAT, _LAYOUT = (_case({k: v[i] for k, v in ARCHIVED.items()}, "b.series") for i in range(3))
_TAG = f"rtrim({_FILE}, '_')"
_NOISE = "CASE WHEN n = 1 OR n = 2 OR n >= 5 OR round_even(value*100, 0) = 0 THEN NULL ELSE round_even(value*100, 0) END"

QUERIES = {
    "asof_roles": (asof_roles, (
        f"WITH {ROLES_SQL} SELECT id AS event_id, series, sat AS source_sat, role FROM roled")),
    "asof_by_series": (asof_by_series, (
        f"WITH h AS (SELECT series, {bin_start('idx', 60)} AS a, n FROM ({bins_sql(EVENT_OBS, 60)})), "
        f"e AS (SELECT id, series, t + INTERVAL 90 MINUTE AS t FROM ({EVENT_OBS})) "
        f"SELECT id AS event_id, e.series, {ts('a', 'hour_start')}, n AS hour_n FROM e ASOF LEFT JOIN h ON e.series = h.series AND e.t >= h.a")),
    "regrid_labels": (regrid_labels, (
        f"WITH {LEADERS_SQL}, five AS (SELECT series, make_timestamp(CAST(floor(epoch_us(t) / 300000000) AS BIGINT) * 300000000) AS t, "
        "max(sat) AS sat, count(*) AS n FROM smp GROUP BY 1, 2), st AS (SELECT *, lag(t) OVER (PARTITION BY series ORDER BY t) AS pt FROM five), "
        "sg AS (SELECT *, sum(CASE WHEN t - pt > INTERVAL 20 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY t) AS segment FROM st), "
        "segs AS (SELECT series, CAST(segment AS BIGINT) AS segment, min(t) AS a, max(t) AS b FROM sg GROUP BY 1, 2), "
        "g AS (SELECT series, segment, unnest(generate_series(a, b, INTERVAL 5 MINUTE)) AS t FROM segs), "
        "rg AS (SELECT g.*, n, coalesce(TRY_CAST(g.series[2:] AS INTEGER), sat) AS sat FROM g LEFT JOIN five USING (series, t)) "
        f"SELECT series, segment, {ts('rg.t', 'time_utc')}, coalesce(n, 0) AS n, coalesce(sat, -1) AS source_sat, CASE WHEN rg.t < TIMESTAMP '{ERA_START}' THEN 'before' ELSE 'after' END AS era, "
        "CASE WHEN series = 'Gp' THEN 'primary' WHEN series = 'Gs' THEN 'secondary' WHEN sat = p THEN 'primary' WHEN sat = s THEN 'secondary' "
        "ELSE 'other' END AS role FROM rg ASOF LEFT JOIN lead ON rg.t >= lead.a")),
    "undesignated_roles": (undesignated_roles, (
        f"WITH {SAMPLES_SQL} SELECT series, CASE series WHEN 'Gp' THEN 'primary' WHEN 'Gs' THEN 'secondary' "
        "ELSE 'undesignated' END AS role, count(*) AS n_rows FROM smp GROUP BY 1, 2")),
    "asof_lines": (asof_lines, f"""
        WITH e AS (SELECT l_suppkey AS k, CAST(l_shipdate AS TIMESTAMP) + INTERVAL 30 DAY AS a, l_shipdate AS d, l_orderkey AS o, l_linenumber AS n
                   FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey DESC, l_linenumber DESC) = 1),
        l AS (SELECT *, CAST(l_shipdate AS TIMESTAMP) AS t FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_suppkey, {ts('t', 'l_shipdate')}, {ts('e.d', 'earlier_date')}, e.o AS earlier_order, e.n AS earlier_line
        FROM l ASOF LEFT JOIN e ON l.l_suppkey = e.k AND l.t >= e.a"""),
    "interval_build": (interval_build, f"""WITH {SITE_LEADERS_SQL},
        day AS (SELECT site, a, CASE WHEN n1 >= {LEAD_SHARE} * n2 THEN CAST(p AS VARCHAR) END AS p,
                CASE WHEN n1 >= {LEAD_SHARE} * n2 THEN CAST(s AS VARCHAR) END AS s, n1 >= {LEAD_SHARE} * n2 AS cited FROM lead),
        lim AS (SELECT site, min(a) AS lo, max(a) + INTERVAL 1 DAY AS hi FROM lead GROUP BY site),
        c AS (SELECT * FROM day WHERE cited),
        f AS (SELECT *, CASE WHEN lag(p) OVER w = p AND lag(s) OVER w IS NOT DISTINCT FROM s AND lag(a) OVER w + INTERVAL 1 DAY = a
              THEN 0 ELSE 1 END AS nw FROM c WINDOW w AS (PARTITION BY site ORDER BY a)),
        g AS (SELECT *, sum(nw) OVER (PARTITION BY site ORDER BY a) AS k FROM f),
        m AS (SELECT site, min(a) AS x, max(a) + INTERVAL 1 DAY AS y, p, s FROM g GROUP BY site, k, p, s),
        n AS (SELECT *, lag(y) OVER (PARTITION BY site ORDER BY x) AS py FROM m),
        u AS (SELECT site, x, y, p, s FROM m
              UNION ALL SELECT n.site, coalesce(py, lo), x, 'unknown', 'unknown' FROM n JOIN lim USING (site) WHERE coalesce(py, lo) < x
              UNION ALL SELECT site, coalesce(my, lo), hi, 'unknown', 'unknown' FROM lim LEFT JOIN
                (SELECT site, max(y) AS my FROM m GROUP BY site) USING (site) WHERE coalesce(my, lo) < hi)
        SELECT site, {ts('x', 'start_utc')}, {ts('y', 'end_utc')}, p AS primary_sat, s AS secondary_sat FROM u"""),
    "interval_violations": (interval_violations, f"""WITH {SITE_LEADERS_SQL}, x AS (SELECT *, lead(a) OVER (PARTITION BY site ORDER BY a) AS na,
        a + CASE WHEN n1 >= {LEAD_SHARE} * n2 THEN INTERVAL 1 DAY ELSE INTERVAL 2 DAY END AS e FROM lead)
        SELECT site, strftime(a, '%Y-%m-%dT%H:%M:%SZ') AS start_utc, 'not contiguous with the next row' AS problem FROM x WHERE e <> na
        UNION ALL SELECT site, strftime(a, '%Y-%m-%dT%H:%M:%SZ'), 'invalid secondary satellite' FROM x WHERE n2 > 20"""),
    "interval_overlaps": (interval_overlaps, f"""
        WITH a AS (SELECT series, t, lag(t) OVER (PARTITION BY series ORDER BY t) AS pt FROM ({EVENT_OBS})),
        b AS (SELECT *, sum(CASE WHEN t - pt > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER
              (PARTITION BY series ORDER BY t) AS g FROM a),
        s AS (SELECT series, min(t) AS x, max(t) AS y FROM b GROUP BY series, g)
        SELECT l.series AS left_name, q.series AS right_name, {ts('greatest(l.x, q.x)', 'overlap_start')},
        {ts('least(l.y, q.y)', 'overlap_end')} FROM s l JOIN s q ON l.series < q.series
        AND greatest(l.x, q.x) < least(l.y, q.y)"""),
    "archive_files": (archive_files, f"""
        WITH {_B5}, p AS (SELECT {_FILE} AS tag, t, n FROM b),
        f AS (SELECT strftime(t, '%Y%m%d') AS day, tag, count(*) AS n_rows, min(t) AS a, max(t) AS b, sum(n) AS total FROM p GROUP BY 1, 2),
        m AS (SELECT series, value, {bin_start('idx', 1)} AS t FROM ({bins_sql(EVENT_OBS, 1)})),
        x AS (SELECT {_FILE} AS tag, t, round_even(value * 100, 0) AS k FROM m AS b),
        g AS (SELECT strftime(t, '%Y%m%d') AS day, tag, count(*) AS n_rows, min(t) AS a, max(t) AS b,
              sum(CASE WHEN k <> 0 AND k <= 10000 THEN k * 1e-6 END) AS total FROM x GROUP BY 1, 2)
        SELECT 'particle' AS kind, day || '_' || tag || 'part_5m.txt' AS src_file, rtrim(tag, '_') AS series, n_rows, {ts('a', 'time_start')},
               {ts('b', 'time_end')}, {r('total', 'total')}, NULL AS note FROM f
        UNION ALL SELECT 'particle', day || '_G13part_5m.txt', 'G13', 0, NULL, NULL, NULL, 'empty source file' FROM f WHERE tag = 'G9'
        UNION ALL SELECT 'xray', day || '_' || tag || 'xr_1m.txt', rtrim(tag, '_'), n_rows, {ts('a', 'time_start')},
               {ts('b', 'time_end')}, {r('total', 'total')}, NULL FROM g"""),
    "parse_archive_text": (parse_archive_text, (
        f"WITH {_B5} SELECT {ts('t', 'time_utc')}, {_TAG} AS series, {_SAT} AS source_sat, "
        f"CASE WHEN {_LAYOUT} <> 'kasi' THEN 'W075' END AS location, "
        f"CASE WHEN {_LAYOUT} = 'kasi' THEN 'kasi_2020_' ELSE 'noaa_1998_2019' END AS era, "
        f"{r(_NOISE, 'p_gt1')}, {r('n', 'p_gt5')}, CAST(NULL AS DOUBLE) AS p_gt60, "
        + ", ".join(r(f"CASE WHEN {_LAYOUT} {test} THEN {v} END", c) for c, test, v in (
            ("e_gt0p6", "= 'noaa_0p6'", "n"), ("e_gt0p8", "= 'noaa_0p8'", "n"), ("e_gt4", "<> 'kasi'", "7")))
        + f", strftime(t, '%Y%m%d') || '_' || {_FILE} || 'part_5m.txt' AS src_file FROM b")),
    "archive_provenance": (archive_provenance, (
        f"WITH {_B5} SELECT 'archive/' || strftime(t, '%Y%m%d') || '_' || {_FILE} || 'part_5m.txt' AS path, "
        f"{_TAG} AS series, CASE WHEN {_LAYOUT} = 'kasi' THEN 'kasi' ELSE 'noaa' END AS format, "
        f"{_SAT} AS source_sat, count(*) AS n_rows, {ts('min(t)', 'time_start')}, {ts('max(t)', 'time_end')}, "
        f"CASE {_LAYOUT} WHEN 'kasi' THEN 'p_gt1,p_gt5,p_gt10,p_gt30,p_gt50,p_gt60,p_gt100,p_gt500,e_gt2' "
        "WHEN 'noaa_0p6' THEN 'p_gt1,p_gt5,p_gt10,p_gt30,p_gt50,p_gt100,e_gt0p6,e_gt2,e_gt4' ELSE "
        "'p_gt1,p_gt5,p_gt10,p_gt30,p_gt50,p_gt100,e_gt0p8,e_gt2,e_gt4' END AS channels "
        "FROM b GROUP BY strftime(t, '%Y%m%d'), b.series")),
    "ceiling_mask": (ceiling_mask, (
        f"SELECT series, CAST(sum(CASE WHEN v > 100 THEN 1 ELSE 0 END) AS BIGINT) AS n_masked, "
        f"{r('max(CASE WHEN v <= 100 AND v <> 0 THEN v END)', 'max_kept')}, "
        f"count(CASE WHEN v <= 100 AND v <> 0 THEN v END) AS n_kept FROM ({EVENT_OBS}) GROUP BY series")),
    "regime_labels": (regime_labels, (
        "SELECT o_orderkey, 'G' || c_nationkey AS series, c_nationkey AS sat, "
        "CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'early' ELSE 'late' END AS era, "
        f"CASE WHEN c_nationkey >= 16 THEN '{labels.REGIME_NEW}' ELSE '{labels.REGIME_OLD}' END AS regime, "
        "CASE c_nationkey WHEN 13 THEN 'goes13_anomalous_mode' WHEN 19 THEN 'maturity_check_goes19' ELSE '' END "
        "AS flags, CASE c_nationkey WHEN 13 THEN $a$" + labels.NOTE_ANOMALOUS + "$a$ WHEN 16 THEN $a$" + labels.NOTE_GOES_R
        + "$a$ WHEN 19 THEN $a$" + labels.NOTE_MATURITY + "$a$ ELSE '' END AS notes FROM orders JOIN customer ON o_custkey = c_custkey")),
    "legacy_names": (legacy_names, f"""
        WITH n AS (SELECT DISTINCT 'g' || lpad(CAST(o_orderkey % 8 + 8 AS VARCHAR), 2, '0') || '_' ||
            ['eps', 'epead_p17ew', 'hepad_s2', 'magn', 'HEPAD', 'epead_cpflux', 'hepad_ap'][CAST(o_orderkey % 7 + 1 AS INTEGER)] || '_' ||
            o_orderpriority[1] || 'm_' || strftime(o_orderdate, '%Y%m%d') || '_' || strftime(o_orderdate, '%Y%m%d') ||
            ['', '_science', '_v1.0', '_science_v2.1.0', '_v'][CAST(o_orderkey % 5 + 1 AS INTEGER)] || ['.nc', '.NC', '.csv'][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS filename,
            o_orderkey % 8 + 8 AS s, o_orderkey % 7 AS i, o_orderkey % 5 AS v, o_orderkey % 3 AS e, o_orderpriority[1] AS c, o_orderdate AS d FROM orders)
        SELECT filename, CAST(s AS INTEGER) AS sat, lower(['eps', 'epead_p17ew', 'hepad_s2', 'magn', 'HEPAD', 'epead_cpflux', 'hepad_ap'][CAST(i + 1 AS INTEGER)]) AS instrument,
            c || 'm' AS cadence, strftime(d, '%Y-%m-%d') AS first_day, strftime(d, '%Y-%m-%d') AS last_day FROM n WHERE i <> 3 AND v <> 4 AND e <> 2"""),
    "latest_version": (latest_version, (
        f"WITH {_NAMES_SQL}, y AS (SELECT *, row_number() OVER (PARTITION BY sat, year "
        "ORDER BY p DESC, m DESC, d DESC) AS k FROM names WHERE year IS NOT NULL) "
        "SELECT sat, year, p || '-' || m || '-' || d AS version, filename FROM y WHERE k = 1")),
    "latest_file_per_satellite": (latest_file_per_satellite, (
        f"WITH {_NAMES_SQL} SELECT sat, max(filename) AS filename FROM names WHERE year IS NOT NULL GROUP BY sat")),
    "dedup_last": (dedup_last, _DUP.replace("{pick}", "arg_max")),
    "dedup_first": (dedup_first, _DUP.replace("{pick}", "arg_min")),
    "checksums": (checksums, ("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, "
                              "octet_length(encode(text)) AS n_bytes FROM documents")),
    "json_summary": (json_summary, (
        "WITH e AS (SELECT ts, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) "
        "SELECT (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT event_type AS x FROM e)) AS series, "
        "(SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM (SELECT DISTINCT k AS x FROM e WHERE k IS NOT NULL)) "
        "AS energies, '{\"n\":' || count(DISTINCT k) || ',\"top\":' || max(k) || '}' AS meta, "
        f"{ts('min(ts)', 'first_time')}, {ts('max(ts)', 'last_time')} FROM e")),
    "qc_roles": (qc_roles, (
        f"WITH {ROLES_SQL} SELECT series, role, count(*) AS n_rows FROM roled GROUP BY 1, 2")),
    "qc_missing": (qc_missing, (
        f"WITH {_B5}, k AS (SELECT count(DISTINCT idx) AS nb FROM b) SELECT series AS channel, "
        f"{r('1 - count(value) * 1.0 / nb', 'missing_share')} FROM b, k GROUP BY series, nb")),
    "qc_timeline": (qc_timeline, (
        f"WITH {ROLES_SQL} SELECT sat AS source_sat, {ts('min(t)', 'first_time')}, {ts('max(t)', 'last_time')}, "
        "count(*) AS n_rows FROM roled WHERE role = 'primary' GROUP BY sat")),
    "qc_fill_mask": (qc_fill_mask, " UNION ALL ".join(
        f"SELECT l_returnflag, count(*) AS n, '{c}' AS variable, count_if({m}) AS n_masked, "
        f"{r(f'count_if({m}) * 1.0 / count(*)', 'masked_fraction')} FROM lineitem GROUP BY 1"
        for c, m in _MASK.items())),
    "qc_cadence": (qc_cadence, (
        "WITH a AS (SELECT series, t, (epoch_us(t) - epoch_us(lag(t) OVER (PARTITION BY series ORDER BY id))) / 1e6 "
        f"AS st FROM ({EVENT_OBS})), m AS (SELECT series, median(st) AS c FROM a GROUP BY 1) "
        f"SELECT series, {r('c', 'cadence_s')}, count(*) AS n, count_if(st > 1.5 * c) AS n_gaps, "
        f"CAST(min(st) > 0 AS INTEGER) AS monotonic, {r('max(st)', 'max_gap_s')}, "
        "CAST(round_even((epoch_us(max(t)) - epoch_us(min(t))) / 1e6 / c, 0) AS BIGINT) + 1 AS expected_n, "
        + r("count(*) / (round_even((epoch_us(max(t)) - epoch_us(min(t))) / 1e6 / c, 0) + 1)", "coverage")
        + " FROM a JOIN m USING (series) GROUP BY series, c")),
    "qc_rollup": (qc_rollup, (
        "SELECT o_orderstatus, string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR), ',' ORDER BY CAST(year(o_orderdate) AS VARCHAR)) AS years, "
        "string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities, "
        f"{ts('min(o_orderdate)', 'first_time')}, {ts('max(o_orderdate)', 'last_time')}, count(*) AS n_rows "
        "FROM orders GROUP BY 1")),
    "qc_duplicates": (qc_duplicates, (
        "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")),
    "qc_categories": (qc_categories, (
        "SELECT o_orderpriority, count(*) AS n_rows FROM orders GROUP BY 1")),
    "qc_orphans": (qc_orphans, (
        "SELECT DISTINCT doc_id, 'left_only' AS side FROM labels ANTI JOIN documents USING (doc_id) "
        "UNION ALL SELECT DISTINCT doc_id, 'right_only' FROM documents ANTI JOIN labels USING (doc_id)")),
    "exact_medians": (exact_medians, (
        f"SELECT l_returnflag, l_linestatus, {r('median(l_extendedprice)', 'median_price')} FROM lineitem GROUP BY 1, 2")),
}
