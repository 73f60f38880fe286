"""Daily text archives: discovery, checksums, headers and rows of both line layouts.

Each file is one row ``(path, text)``; a daily file is a few hundred lines, so header facts are
read with array functions inside the row and only the data lines are exploded. Nothing is joined
back and nothing leaves the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlake.operators.ordered import keep_one

# Fixed values of the file formats: names, patterns, sentinels and column layouts.
MISSING_DEFAULT = -1.0e5
MISSING_TOLERANCE = 1.0
MAX_PHYSICAL_XRAY = 1.0e-2
PROTON = ["p_gt1", "p_gt5", "p_gt10", "p_gt30", "p_gt50", "p_gt60", "p_gt100", "p_gt500"]
ELECTRON = ["e_gt0p6", "e_gt0p8", "e_gt2", "e_gt4"]
SOURCE_LINE = r"(?i)#\s*Source:\s*GOES[- ]?(\d+)"
LOCATION_LINE = r"#\s*Location:\s*(\S+)"
MISSING_LINE = r"#\s*Missing data:\s*([-\d.eE+]+)"
BASENAME = r"([^/]+)$"


@dataclass(frozen=True)
class ArchiveKind:
    glob: str
    name_pattern: str
    channels: tuple[str, ...]
    layouts: dict[str, tuple[str, ...]]     # layout -> channels in token order
    index_tokens: dict[str, int]            # layout -> tokens before the first channel
    era: dict[str, str]
    value_type: str
    whole_lines: bool                       # a line must hold every channel


PARTICLE = ArchiveKind(
    glob="*part_5m.txt",
    name_pattern=r"^\d{8}_(G\d{1,2}|Gp|Gs)_?part_5m\.txt$",
    channels=tuple(PROTON + ELECTRON),
    layouts={
        "noaa_0p6": ("p_gt1", "p_gt5", "p_gt10", "p_gt30", "p_gt50", "p_gt100",
                     "e_gt0p6", "e_gt2", "e_gt4"),
        "noaa_0p8": ("p_gt1", "p_gt5", "p_gt10", "p_gt30", "p_gt50", "p_gt100",
                     "e_gt0p8", "e_gt2", "e_gt4"),
        "kasi": ("p_gt1", "p_gt5", "p_gt10", "p_gt30", "p_gt50", "p_gt60", "p_gt100", "p_gt500",
                 "e_gt2"),
    },
    index_tokens={"noaa_0p6": 6, "noaa_0p8": 6, "kasi": 5},
    era={"noaa_0p6": "noaa_1998_2019", "noaa_0p8": "noaa_1998_2019", "kasi": "kasi_2020_"},
    value_type="float",
    whole_lines=False,
)
XRAY = ArchiveKind(
    glob="*xr_1m.txt",
    name_pattern=r"^\d{8}_(G\d{1,2}|Gp|Gs)_?xr_1m\.txt$",
    channels=("xrs_short", "xrs_long"),
    layouts={"noaa": ("xrs_short", "xrs_long"), "kasi": ("xrs_short", "xrs_long")},
    index_tokens={"noaa": 6, "kasi": 5},
    era={"noaa": "noaa_2002_2019", "kasi": "kasi_2020_"},
    value_type="double",
    whole_lines=True,
)


def basename(path: str | Column) -> Column:
    col = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(col, BASENAME, 1)


def list_files(spark: SparkSession, root: str, kind: ArchiveKind,
               years: list[int] | None = None) -> DataFrame:
    """``path, content, sha256, md5`` of the archive files under ``root/<YYYY>/``.

    Names that do not match the kind's pattern (misfiled products) are skipped. Year folders are
    selected through the read paths, so other years are not listed at all. Spark's file sources pass over files
    without bytes, which have a record too: they are added from :func:`empty_files`.
    """
    paths = [f"{root}/{y}" for y in years] if years else [f"{root}/[0-9][0-9][0-9][0-9]"]
    read = spark.read.format("binaryFile").option("pathGlobFilter", kind.glob).load(paths)
    files = read.select("path", "content", "length").unionAll(
        empty_files(spark, root, years).select("path", F.lit(b"").alias("content"), F.lit(0).cast("long").alias("length")))
    return (
        files.filter(basename("path").rlike(kind.name_pattern))
        .select("path", "content", F.sha2("content", 256).alias("sha256"),
                F.md5("content").alias("md5"), F.col("length").alias("bytes"))
    )


def empty_files(spark: SparkSession, root: str, years: list[int] | None = None) -> DataFrame:
    """``path`` of the files without bytes under ``root/<YYYY>/``; a task lists a year's folder."""
    from pyarrow import fs

    if years is None:
        system, at = fs.FileSystem.from_uri(root)
        years = sorted(int(f.base_name) for f in system.get_file_info(fs.FileSelector(at)) if re.fullmatch(r"\d{4}", f.base_name))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                system, at = fs.FileSystem.from_uri(folder)
                found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
                names = [f"{folder}/{f.base_name}" for f in found if f.is_file and f.size == 0]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["path"])

    folders = spark.createDataFrame([(f"{root}/{y:04d}",) for y in years], "folder string")
    return folders.repartition(max(1, len(years)), "folder").mapInArrow(listed, "path string")


def as_text(files: DataFrame) -> DataFrame:
    """The files as text; bytes that aren't UTF-8 become replacement characters."""
    return files.withColumn("text", F.make_valid_utf8(F.col("content").cast("string"))).drop("content")


def _case(key: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(key == k, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def with_headers(files: DataFrame, kind: ArchiveKind) -> DataFrame:
    """Header facts per file: series, layout, satellite, location, missing value, prepared-by.

    A non-empty file whose layout cannot be told from its text is an error.
    """
    is_data = lambda s: ~s.rlike("^[#:]") & (F.trim(s) != "")
    lines = F.split("text", r"\R")
    first = F.array_position(F.transform("_lines", is_data), True)
    head = F.when(first > 0, F.slice("_lines", 1, F.greatest(first - 1, F.lit(0)).cast("int"))
                  ).otherwise(F.col("_lines"))

    def last_match(pattern: str) -> Column:
        hit = F.get(F.reverse(F.filter("_head", lambda s: s.rlike(pattern))), F.lit(0))
        return F.regexp_extract(hit, pattern, 1)

    labels = F.filter("_head", lambda s: F.ltrim(s).startswith("# Label")
                      & (s.contains("E>0.6") | s.contains("E>0.8")))
    label = F.get(F.reverse(labels), F.lit(0))
    prepared = F.get(F.reverse(F.filter("_head", lambda s: s.startswith("# Prepared by"))), F.lit(0))
    text = F.col("text")
    if "kasi" in kind.layouts and len(kind.layouts) == 3:
        layout = (
            F.when(text.contains(">500") | text.contains("KASI")
                   | text.contains("Korea Astronomy"), "kasi")
            .when(text.contains("Julian") | text.contains("P>100"),
                  F.when(label.contains("E>0.8"), "noaa_0p8").otherwise("noaa_0p6")))
    else:
        by_name = prepared.contains("KASI") | prepared.contains("Korea Astronomy")
        layout = (F.when(by_name, "kasi").when(text.contains("Julian"), "noaa")
                  .when(text.contains("Satellite"), "kasi"))
    blank = F.trim(F.regexp_replace("text", r"\s+", " ")) == ""
    known = F.when(blank, None).otherwise(F.coalesce(
        layout, F.raise_error(F.lit("cannot tell the file layout from its header"))))
    return (
        files.withColumn("_lines", lines).withColumn("_head", head)
        .withColumn("src_file", basename("path"))
        .withColumn("series", F.regexp_extract("src_file", kind.name_pattern, 1))
        .withColumn("layout", known)
        .withColumn("source_sat", last_match(SOURCE_LINE).try_cast("short"))
        .withColumn("location", F.nullif(last_match(LOCATION_LINE), F.lit("")))
        .withColumn("missing_value", F.coalesce(last_match(MISSING_LINE).try_cast("double"),
                                                F.lit(MISSING_DEFAULT)))
        .withColumn("prepared_by", F.trim(F.substring(prepared, 3, 2**31 - 1)))
        .withColumn("era", _case(F.col("layout"), kind.era))
        .drop("_head")
    )


def _time_of(parts: Column) -> Column:
    tok = lambda i: F.get(parts, F.lit(i))
    hhmm = F.when(F.length(tok(3)) < 4, F.lpad(tok(3), 4, "0")).otherwise(tok(3))
    number = lambda c: c.try_cast("int")
    return F.try_make_timestamp(
        number(tok(0)), number(tok(1)), number(tok(2)), number(F.substring(hhmm, 1, 2)),
        number(F.substring(hhmm, 3, 2**31 - 1)), F.lit(0).cast("decimal(8,6)"))


def masked(token: Column, missing: Column) -> Column:
    """Token to value; NULL for text, the declared missing value (within 1) and exactly zero."""
    v = token.try_cast("double")
    fill = (F.abs(v - missing) <= MISSING_TOLERANCE) | (v == 0) | F.isnan(v)
    return F.when(~fill, v)


def parse_rows(files: DataFrame, kind: ArchiveKind) -> DataFrame:
    """Typed rows of ``(path, text)`` files with header facts, line by line.

    Comment and blank lines, lines with a bad date and lines with too few tokens are left out:
    one channel token is enough where ``whole_lines`` is False, and absent channels are NULL.
    """
    headed = files if "layout" in files.columns else with_headers(files, kind)
    lines = (
        headed.filter(F.col("layout").isNotNull())
        .select("path", "src_file", "series", "layout", "source_sat", "location", "missing_value",
                "era", F.posexplode("_lines").alias("line_no", "_raw"))
        .withColumn("_s", F.trim(F.regexp_replace("_raw", r"\s+", " ")))
        .filter((F.col("_s") != "") & ~F.col("_s").rlike("^[#:]"))
        .withColumn("_parts", F.split("_s", " "))
    )
    need = {k: n + (len(kind.channels) if kind.whole_lines else 1)
            for k, n in kind.index_tokens.items()}
    timed = (
        lines.filter(F.size("_parts") >= _case(F.col("layout"), need))
        .withColumn("time_utc", _time_of(F.col("_parts")))
        .filter(F.col("time_utc").isNotNull())
    )
    cols = []
    for channel in kind.channels:
        where = {k: F.get("_parts", F.lit(kind.index_tokens[k] + names.index(channel)))
                 for k, names in kind.layouts.items() if channel in names}
        token = _case(F.col("layout"), where).cast("string")
        cols.append(masked(token, F.col("missing_value")).cast(kind.value_type).alias(channel))
    return timed.select("time_utc", "series", "source_sat", "location", "era", *cols, "src_file",
                        "path", "line_no")


def mask_ceiling(rows: DataFrame, channels: list[str], ceiling: float = MAX_PHYSICAL_XRAY) -> DataFrame:
    """NULL for physically impossible values; ``n_masked`` counts them per row."""
    over = [F.when(F.col(c) > ceiling, 1).otherwise(0) for c in channels]
    total = over[0]
    for c in over[1:]:
        total = total + c
    kept = [F.when(F.col(c) <= ceiling, F.col(c)).alias(c) if c in channels else F.col(c)
            for c in rows.columns]
    return rows.select(*kept, total.alias("n_masked"))


def last_per_time(rows: DataFrame) -> DataFrame:
    """Keep the last row of a repeated (time, series), in file and line order."""
    return keep_one(rows, ["time_utc", "series"], ["path", "line_no"], keep="last")


def provenance(files: DataFrame, rows: DataFrame, kind: ArchiveKind) -> DataFrame:
    """One record per file, empty files included: rows, first and last time, layout, checksum."""
    per_file = rows.groupBy("path").agg(
        F.count("*").alias("_n"), F.min_by("time_utc", "line_no").alias("time_start"),
        F.max_by("time_utc", "line_no").alias("time_end"))
    channels = _case(F.col("layout"), {
        k: F.array(*[F.lit(c) for c in v]) for k, v in kind.layouts.items()})
    facts = [c for c in ("sha256", "md5", "bytes") if c in files.columns]
    return (
        files.join(per_file, "path", "left")
        .select("path", "series", F.regexp_replace("layout", "_0p[68]$", "").alias("format"),
                "prepared_by", "source_sat", "location", channels.alias("channels"),
                F.coalesce("_n", F.lit(0)).alias("n_rows"), "time_start", "time_end", *facts,
                F.when(F.col("layout").isNull(), "empty source file").alias("note"))
    )
