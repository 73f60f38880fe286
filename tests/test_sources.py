import hashlib
import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxlake.functions import labels
from fluxlake.operators import board
from fluxlake.operators.quality import checksum_mismatches, unmatched
from fluxlake.session import build_session, scratch_dir  # noqa: F401
from fluxlake.sources import archive, catalogue, observations, records

HEAD_A = """:Product: test
# Prepared by the test suite
# Source: GOES-9
# Location: W135
# Missing data: -1.00e+05
# Label: E>0.8 = electrons
#                 Modified Julian Seconds
# YR MO DA  HHMM    Day  of the Day  P > 1 P>100
"""
HEAD_B = """# Prepared by KASI
# Source: GOES 16
# Missing data: -1.00e+05
# YR MO DA HHMM Sat P>1 P>500
"""
LINES_A = """1998 06 13  0005   50977    300   1.50e+00 2 3 4 5 6 7 8 9
1998 06 13  0      50977    600  -1.00e+05 0.00e+00 3 -99999.5 x 6 7 8 9

1998 06 13  0010   50977    600   4.00
1998 13 40  0015   50977    900   1 2 3 4 5 6 7 8 9
1998 06 13  0020   50977   1200
1998 06 13  0005   50977    300   2.50e+00 2 3 4 5 6 7 8 9
"""
LINES_B = "2021 01 01 2355 16 1 2 3 4 5 6 7 8 9\n"


@pytest.fixture()
def root(tmp_path):
    for year, name, text in [
        ("1998", "19980613_G9part_5m.txt", HEAD_A + LINES_A),
        ("1998", "19980614_G9part_5m.txt", "  \n"),
        ("1998", "19980613_Gp_xr_1m_part_5m.txt", HEAD_A + LINES_A),
        ("2021", "20210101_Gp_part_5m.txt", HEAD_B + LINES_B),
        ("2021", "20210101_Gp_xr_1m.txt", HEAD_B + "2021 01 01 0001 16 1e-7 5.0\n2021 01 01 0002 16 1e-7\n"
         "2021 01 01 0003 16 0.0 3e-6\n"),
    ]:
        os.makedirs(tmp_path / year, exist_ok=True)
        (tmp_path / year / name).write_text(text)
    return str(tmp_path)


def test_discovery_skips_misfiled_names_and_other_years(spark, root):
    files = archive.list_files(spark, root, archive.PARTICLE)
    names = sorted(r[0] for r in files.select(archive.basename("path")).collect())
    assert names == ["19980613_G9part_5m.txt", "19980614_G9part_5m.txt", "20210101_Gp_part_5m.txt"]
    assert archive.list_files(spark, root, archive.PARTICLE, [2021]).count() == 1
    row = files.filter(F.col("path").contains("2021")).first()
    text = (HEAD_B + LINES_B).encode()
    assert row.sha256 == hashlib.sha256(text).hexdigest() and row.md5 == hashlib.md5(text).hexdigest()


def test_particle_rows(spark, root):
    files = archive.as_text(archive.list_files(spark, root, archive.PARTICLE))
    rows = archive.parse_rows(files, archive.PARTICLE).orderBy("path", "line_no").collect()
    g9 = [r for r in rows if r.series == "G9"]
    assert [r.time_utc for r in g9] == [datetime(1998, 6, 13, 0, m) for m in (5, 0, 10, 5)]
    full = g9[0]
    assert (full.p_gt1, full.p_gt100, full.e_gt0p8, full.e_gt4) == (1.5, 6.0, 7.0, 9.0)
    assert full.e_gt0p6 is None and full.p_gt60 is None
    assert (full.source_sat, full.location, full.era) == (9, "W135", "noaa_1998_2019")
    masked = g9[1]
    assert masked.p_gt1 is None and masked.p_gt5 is None and masked.p_gt30 is None and masked.p_gt50 is None
    assert masked.p_gt10 == 3.0
    assert g9[2].p_gt1 == 4.0 and g9[2].p_gt5 is None
    gp = [r for r in rows if r.series == "Gp"][0]
    assert (gp.p_gt60, gp.p_gt500, gp.e_gt2, gp.source_sat, gp.era) == (6.0, 8.0, 9.0, 16, "kasi_2020_")
    kept = archive.last_per_time(archive.parse_rows(files, archive.PARTICLE))
    assert kept.filter("series = 'G9' AND minute(time_utc) = 5").first().p_gt1 == 2.5


def test_xray_rows_need_all_channels(spark, root):
    files = archive.as_text(archive.list_files(spark, root, archive.XRAY))
    rows = archive.parse_rows(files, archive.XRAY)
    got = [(r.time_utc.minute, r.xrs_short, r.xrs_long) for r in rows.orderBy("time_utc").collect()]
    assert got == [(1, 1e-7, 5.0), (3, None, 3e-6)]
    capped = archive.mask_ceiling(rows, ["xrs_short", "xrs_long"])
    assert [(r.xrs_long, r.n_masked) for r in capped.orderBy("time_utc").collect()] == [(None, 1), (3e-6, 0)]


def test_provenance_keeps_empty_files(spark, root):
    files = archive.with_headers(archive.as_text(archive.list_files(spark, root, archive.PARTICLE)),
                                 archive.PARTICLE)
    out = archive.provenance(files, archive.parse_rows(files, archive.PARTICLE), archive.PARTICLE)
    by = {os.path.basename(r.path): r for r in out.collect()}
    empty = by["19980614_G9part_5m.txt"]
    assert (empty.n_rows, empty.note, empty.series) == (0, "empty source file", "G9")
    a = by["19980613_G9part_5m.txt"]
    assert (a.n_rows, a.format, a.prepared_by) == (4, "noaa", "Prepared by the test suite")
    assert a.time_start == datetime(1998, 6, 13, 0, 5) and a.channels[6] == "e_gt0p8"


def test_unknown_layout_is_an_error(spark):
    df = spark.createDataFrame([("x/19980613_G9part_5m.txt", "# hello\n1 2 3\n")], "path string, text string")
    with pytest.raises(Exception, match="layout"):
        archive.parse_rows(df, archive.PARTICLE).collect()


def test_name_patterns(spark):
    names = {"19980613_G9part_5m.txt": "G9", "20100601_Gp_part_5m.txt": "Gp", "20030101_G12part_5m.txt": "G12",
             "20130101_Gp_xr_1m.txt": ""}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.s for r in df.select("n", F.regexp_extract("n", archive.PARTICLE.name_pattern, 1).alias("s")).collect()}
    assert got == names


def test_sorted_sink_and_scans(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2003, 1, 2), "b", float("nan")), (datetime(2002, 1, 2), "a", 1.0)],
                               "time_utc timestamp, series string, value double")
    out = str(tmp_path / "obs")
    observations.write_sorted(observations.clean_types(df), out)
    assert sorted(os.path.basename(p) for p in os.listdir(out) if p.startswith("year")) == ["year=2002", "year=2003"]
    back = observations.scan(spark, out, ["time_utc", "value"])
    assert back.columns == ["time_utc", "value"] and back.filter("value IS NULL").count() == 1
    with pytest.raises(ValueError):
        observations.scan(spark, out, ["nope"])
    csv = tmp_path / "x.csv"
    csv.write_text("time,flux,extra\n2020-01-01,1,5\n2020-01-02,2,6\n")
    table = observations.scan(spark, str(csv))
    assert observations.csv_feature_columns(table, "flux", "time") == ["extra"]
    assert table.agg(F.sum("flux")).first()[0] == 3


def test_scan_is_pruned_and_filters_are_pushed(spark, tmp_path):
    out = str(tmp_path / "p")
    spark.range(10).select(F.col("id"), F.lit("primary").alias("role"), F.lit(1.0).alias("v")).write.parquet(out)
    plan = observations.filter_role(observations.scan(spark, out, ["id", "role"]))._jdf.queryExecution().toString()
    assert "EqualTo(role,primary)" in plan and "ReadSchema: struct<id:bigint,role:string>" in plan


def test_channel_specs():
    assert observations.ChannelSpec.parse("a:b.parquet:x") == ("a:b.parquet", "x")
    for bad in ("x", ":x", "x:"):
        with pytest.raises(ValueError):
            observations.ChannelSpec.parse(bad)
    assert observations.targets_among(["a", "b"]) == ["a"]
    assert observations.targets_among(["a", "b"], ["b"]) == ["b"]
    with pytest.raises(ValueError):
        observations.targets_among(["a"], ["z"])


def test_bad_bytes_are_replaced(spark):
    files = spark.createDataFrame([("p", bytearray(b"A\xffB"))], "path string, content binary")
    from fluxlake.sources.archive import as_text
    assert as_text(files).first().text == "A\ufffdB"


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        scratch_dir(Session(), "x")


MANIFEST = T.StructType([T.StructField("local_path", T.StringType()), T.StructField("sha256", T.StringType()),
                         T.StructField("channels", T.MapType(T.StringType(), T.StringType())),
                         T.StructField("retrieved_utc", T.StringType()), T.StructField("pos", T.IntegerType())])


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    lines = [{"local_path": "d/a.nc", "sha256": "1", "channels": {"x": "y"}, "pos": 0},
             {"local_path": "d/b.nc", "sha256": "2", "retrieved_utc": "t2", "pos": 1},
             {"local_path": "d/a.nc", "sha256": "3", "pos": 2, "retrieved_utc": "t3"},
             {"local_path": "e/b.nc", "sha256": "4", "retrieved_utc": "t4", "pos": 3}]
    text = [json.dumps(x) for x in lines]
    path.write_text("\n".join([text[0], "{broken", text[1], text[2], "", text[3]]))
    m = records.read_manifest(spark, str(path), MANIFEST)
    assert {r.local_path: r.sha256 for r in m.collect()} == {"d/a.nc": "3", "d/b.nc": "2", "e/b.nc": "4"}
    first = records.first_by_basename(m, "pos", "retrieved_utc")
    assert {r.name: r.retrieved_utc for r in first.collect()} == {"a.nc": "t3", "b.nc": "t2"}
    new = spark.createDataFrame([("d/b.nc", "9")], "local_path string, sha256 string")
    out = str(tmp_path / "up")
    records.write_manifest(records.upsert_manifest(m, new), out)
    again = records.read_manifest(spark, out, MANIFEST)
    assert {r.local_path: r.sha256 for r in again.collect()} == {"d/a.nc": "3", "d/b.nc": "9", "e/b.nc": "4"}
    bad = checksum_mismatches(m, again, "local_path", "sha256").collect()
    assert [(b.local_path, b.recorded, b.actual) for b in bad] == [("d/b.nc", "2", "9")]
    sides = unmatched(m.limit(0), m, "local_path")
    assert sides.filter("side = 'right_only'").count() == 3


def test_snapshot_and_summary(spark, tmp_path):
    (tmp_path / "instrument-sources_20250101.json").write_text(json.dumps([{"time_tag": "2025-01-01T00:00:00Z",
                                                                           "protons": {"primary": 16, "secondary": 18}}]))
    (tmp_path / "instrument-sources_20260101.json").write_text(json.dumps([
        {"time_tag": "2026-01-01T00:10:00Z", "protons": {"primary": 19, "secondary": 18}},
        {"time_tag": "2020-01-01T00:10:00Z", "protons": {"primary": 1, "secondary": 2}}]))
    row = records.read_snapshot(spark, f"{tmp_path}/instrument-sources_*.json").first()
    assert tuple(row) == ("2026-01-01T00:10:00Z", "open", "proton", "19", "18")
    (tmp_path / "instrument-sources_20270101.json").write_text(json.dumps([{"time_tag": "2026-01-01T00:10:00Z"}]))
    with pytest.raises(Exception, match="primary"):
        records.read_snapshot(spark, f"{tmp_path}/instrument-sources_*.json").collect()


def test_catalogue(spark):
    names = ["sci_xrsf-l2-avg1m_g16_y2020_v2-2-1.nc", "sci_xrsf-l2-avg1m_g16_y2020_v2-10-0.nc",
             "sci_xrsf-l2-avg1m_g16_s20170101_e20200101_v2-2-1.nc", "sci_xrsf-l2-avg1m_g13_s20170101_e20200101_v1-0-0.nc",
             "readme.txt", "sci_sgps-l2-avg5m_g18_d20240305_v3-0-1.nc"]
    df = spark.createDataFrame([(n,) for n in names], "filename string")
    cat = catalogue.yearly_catalogue(df)
    assert cat.count() == 4
    kept = {r.filename for r in catalogue.without_missions(cat).collect()}
    assert kept == {names[0], names[1], names[3]}
    top = catalogue.latest_version(cat.filter("NOT full_mission"), ["sat", "year"]).collect()
    assert [(r.sat, r.year, r.version) for r in top] == [(16, 2020, "2-10-0")]
    day = catalogue.daily_catalogue(df).first()
    assert (day.cadence, day.sat, str(day.day), day.version) == ("avg5m", 18, "2024-03-05", "3-0-1")


def test_predictions_and_records(spark, tmp_path):
    from tests.test_evaluate import HOURS, PRED, TRUE, predictions
    from fluxlake.operators.evaluate import evaluate, master_layout
    pred = predictions(spark, PRED, TRUE, HOURS)
    records.write_predictions(pred, str(tmp_path / "pred"))
    back = records.read_predictions(spark, str(tmp_path / "pred"))
    ev = master_layout(evaluate(back.select(*pred.columns), {"c": 10.0}))
    again = master_layout(evaluate(pred, {"c": 10.0}))
    assert sorted(map(str, ev.event.collect())) == sorted(map(str, again.event.collect()))
    nested = records.to_records(ev.regression, ev.event)
    records.write_records(nested, str(tmp_path / "rec"))
    rec = records.read_records(spark, str(tmp_path / "rec"), nested.schema)
    assert board.n_foreign_records(rec) == 0
    rows = board.records_to_rows(rec, "event", ["track", "model"]).collect()
    assert {r.granularity: r.tp for r in rows} == {"point": 1, "window": 2, "day": 1}
    old = rec.withColumn("format", F.lit(None).cast("int"))
    assert board.records_to_rows(old, "event", ["track"]).count() == 0 and board.n_foreign_records(old) == 1
    records.write_report(ev.event, str(tmp_path / "csv"), ["model", "granularity"], single_file=True)
    csv = [p for p in os.listdir(tmp_path / "csv") if p.endswith(".csv")]
    assert len(csv) == 1
    text = (tmp_path / "csv" / csv[0]).read_text().splitlines()
    assert text[0].startswith("track,seq_len") and ",3,2,1,1,1,0," in text[1]


def test_labels(spark):
    df = spark.createDataFrame([("G13", "bench/multi_seq288_pred36_f4_direct", 288), ("Gp", "x_seq1", 72)],
                               "s string, n string, l int")
    rows = df.select(labels.satellite_number("s").alias("sat"), *labels.parse_cell_name("n"),
                     labels.input_length("l").alias("len"), labels.regime_flags(labels.satellite_number("s")).alias("f")).collect()
    assert rows[0].sat == 13 and rows[0].track == "multi" and rows[0].fold == 4 and rows[0].len == "1-day"
    assert rows[0].f == ["goes13_anomalous_mode"]
    assert rows[1].sat is None and rows[1].track is None and rows[1].len == "6-hour"


def test_run_names_of_any_track(spark):
    tracks = ("uni_a", "a.b", "multi")
    cells = [(t, n, n + 1, n % 3, s) for n, t in enumerate(tracks) for s in labels.STRATEGIES]
    df = spark.createDataFrame(cells, "t string, q int, p int, f int, s string").select(
        labels.cell_name(*[F.col(c) for c in "tqpfs"]).alias("n"))
    assert sorted(tuple(r) for r in df.select(*labels.parse_cell_name("n", tracks)).collect()) == sorted(cells)
    other = ["multi_seq1_pred2_f3", "axb_seq1_pred2_f3_direct", "uni_b_seq1_pred2_f3_direct", "bench/multi_seq1_pred2_f3_direct ",
             "x/multi_seq1_pred2_f3_direct", "multi_seqx_pred2_f3_direct", "", None]
    none = spark.createDataFrame([(n,) for n in other], "n string").select(*labels.parse_cell_name("n", tracks)).collect()
    assert all(v is None for r in none for v in r)


def test_input_lengths_and_cells(spark):
    df = spark.createDataFrame([(288, 0.5124, 15, 15), (7 * 288, 0.5, 14, 15), (1, None, 0, 15), (30, None, None, 15), (100_000, 1.0, 1, 1)],
                               "l int, m double, k long, n long")
    rows = df.select(labels.input_length("l").alias("i"), labels.score_cell("m", "k", "n").alias("c")).collect()
    assert [r.i for r in rows] == ["1-day", "7-day", "0.0833333-hour", "2.5-hour", "8333.33-hour"]
    assert [r.c for r in rows] == ["0.512", "0.500 (14/15)", "-- (0/15)", "--", "1.000"]


def test_intermediate_tables_are_deleted_on_request(spark):
    from fluxlake.session import drop_scratch, materialize

    table = materialize(spark.range(5).toDF("id"), "gone")
    path = table.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    assert drop_scratch(spark) >= 1 and not os.path.exists(path)


VERSIONED = T.StructType([T.StructField("local_path", T.StringType()), T.StructField("sha256", T.StringType())])


def test_manifest_versions_survive_a_crash(spark, tmp_path):
    root = str(tmp_path / "m")
    frame = lambda *rows: spark.createDataFrame(list(rows), VERSIONED)
    shown = lambda: sorted(tuple(r) for r in records.current_manifest(spark, root, VERSIONED).collect())
    assert shown() == [] and records.current_version(spark, root) is None
    first = records.commit_upsert(spark, root, frame(("a", "1"), ("b", "1")), VERSIONED)
    assert shown() == [("a", "1"), ("b", "1")]
    # a writer that dies before the pointer moves: half a version, and a staged pointer
    frame(("a", "broken")).write.json(f"{root}/version-half")
    (tmp_path / "m" / "CURRENT-version-half").write_text("version-half")
    assert shown() == [("a", "1"), ("b", "1")] and records.current_version(spark, root) == first
    old = records.current_manifest(spark, root, VERSIONED)
    second = records.commit_upsert(spark, root, frame(("b", "2"), ("c", "2")), VERSIONED)
    assert shown() == [("a", "1"), ("b", "2"), ("c", "2")]
    # a reader that opened the first version still reads it, until versions are dropped
    assert sorted(tuple(r) for r in old.collect()) == [("a", "1"), ("b", "1")]
    assert records.drop_versions(spark, root) == 3
    assert sorted(p.name for p in (tmp_path / "m").iterdir() if not p.name.startswith(".")) == ["CURRENT", second]
    assert shown() == [("a", "1"), ("b", "2"), ("c", "2")]


def test_named_files_are_written_by_tasks_and_appear_at_once(spark, tmp_path):
    from fluxlake.sources.files import write_named_files

    root = f"file://{tmp_path}/archive"
    rows = [(f"20{k % 3:02d}/day {k}.txt", bytes([k, 255])) for k in range(30)] + [("top.txt", b""), ("20/none.txt", None)]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(7)
    write_named_files(df, root)
    found = {str(p.relative_to(tmp_path / "archive")): p.read_bytes() for p in (tmp_path / "archive").rglob("*") if p.is_file()}
    assert found == {name: content or b"" for name, content in rows}
    assert [p.name for p in tmp_path.iterdir()] == ["archive"]
    back = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    assert back.count() == len(rows) - 2  # Spark passes over files without bytes
    with pytest.raises(Exception, match="exists"):
        write_named_files(df, root)
    for bad in ("../x", "/x", "a//b", "_temporary/x"):
        with pytest.raises(Exception, match="not a path below"):
            write_named_files(spark.createDataFrame([("ok", b"1"), (bad, b"")], "path string, content binary"), f"{root}2")


def test_legacy_proton_names_and_notes(spark):
    names = ["g13_epead_p17ew_5m_20110101_20110131.nc", "G08_EPS_1m_20000201_20000229_science_v1.0.2.nc", "g15_hepad_s11_1m_20120301_20120331.nc",
             "g13_magn_1m_20110101_20110131.nc", "g13_eps_5m_20110101.nc", "xg13_eps_5m_20110101_20110131.nc", None]
    df = spark.createDataFrame([(n,) for n in names], "filename string")
    got = sorted((r.sat, r.instrument, r.cadence, r.first_day.isoformat(), r.last_day.day) for r in catalogue.legacy_proton_catalogue(df).collect())
    assert got == [(8, "eps", "1m", "2000-02-01", 29), (13, "epead_p17ew", "5m", "2011-01-01", 31), (15, "hepad_s11", "1m", "2012-03-01", 31)]
    sats = spark.createDataFrame([(n,) for n in (8, 13, 16, 19)], "s int").select("s", labels.regime_notes("s").alias("n")).orderBy("s").collect()
    assert [len(r.n) for r in sats] == [0, 1, 1, 1] and "2013-06-07" in sats[1].n[0] and "2017" in sats[2].n[0]
