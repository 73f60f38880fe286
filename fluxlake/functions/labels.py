"""Label columns: satellite numbers, eras, calibration regimes, names and display maps."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Era boundary, regime texts, flags and notes, file names.
ERA_BOUNDARY = "2020-01-01"
REGIME_NEW = "goes-r (GOES-16..19); GOES-16 onward = new XRS calibration regime"
REGIME_OLD = "pre-goes16 (legacy GOES-08..15, EPS-era reprocessed)"
FLAG_ANOMALOUS = (13, "goes13_anomalous_mode")
FLAG_MATURITY = (19, "maturity_check_goes19")
YEARLY_NAME = r"(?i)^sci_xrsf-l2-avg1m_g(\d{2})_y(\d{4})_v(\d+-\d+-\d+)\.nc$"
MISSION_NAME = r"(?i)^sci_xrsf-l2-avg1m_g(\d{2})_s(\d{8})_e(\d{8})_v(\d+-\d+-\d+)\.nc$"
NOTE_GOES_R = ("GOES-16 marks the GOES-R XRS calibration-regime transition (~2017); do not splice across the legacy/GOES-R "
               "boundary without flagging (spec §6).")
NOTE_ANOMALOUS = ("GOES-13 XRS science-quality begins 2013-06-07; early-mission anomalous/dip behavior preceded it -- do not "
                  "splice pre-science data (spec §6).")
NOTE_MATURITY = ("GOES-19 recent period may be 'provisional' maturity; confirm against README/version table (spec §6).")
LEGACY_PROTON_NAME = (r"(?i)^g(\d{2})_(eps|epead_p17ew|epead_cpflux|hepad_ap|hepad_s\d+|hepad)"
                      r"_(\d+m)_(\d{8})_(\d{8})(?:_science)?(?:_v[\d.]+)?\.nc$")
DAILY_NAME = r"(?i)^sci_sgps-l2-(avg1m|avg5m)_g(\d{2})_d(\d{8})_v(\d+-\d+-\d+)\.nc$"

TRACKS = ("uni_a", "uni_b", "multi")
STRATEGIES = ("direct", "recursive", "statistic")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def satellite_number(series: str | Column) -> Column:
    """``G13`` -> 13; NULL for other series names."""
    s = _col(series)
    return F.when(s.rlike(r"^G\d{1,2}$"), F.substring(s, 2, 2).try_cast("short"))


def era(time: str | Column, before: str, after: str, boundary: str = ERA_BOUNDARY) -> Column:
    return F.when(_col(time) < F.lit(boundary).cast("timestamp"), before).otherwise(after)


def regime(sat: str | Column) -> Column:
    return F.when(_col(sat) >= 16, REGIME_NEW).otherwise(REGIME_OLD)


def regime_flags(sat: str | Column) -> Column:
    """Array of the flags that apply to a satellite (empty when none does)."""
    flags = F.array(*[F.when(_col(sat) == n, F.lit(text))
                      for n, text in (FLAG_ANOMALOUS, FLAG_MATURITY)])
    return F.filter(flags, lambda x: x.isNotNull())


def regime_notes(sat: str | Column) -> Column:
    """Array of the notes for a satellite (empty when there is none)."""
    notes = F.array(*[F.when(_col(sat) == n, F.lit(text))
                      for n, text in ((16, NOTE_GOES_R), (13, NOTE_ANOMALOUS), (19, NOTE_MATURITY))])
    return F.filter(notes, lambda x: x.isNotNull())


def display(col: str | Column, names: dict[str, str]) -> Column:
    """Display name of a code, the code itself when it has none."""
    c = _col(col)
    out = c
    for code, name in names.items():
        out = F.when(c == code, name).otherwise(out)
    return out


def cell_name(track: Column, seq: Column, pred: Column, fold: Column, strategy: Column) -> Column:
    return F.format_string("%s_seq%d_pred%d_f%d_%s", track, seq, pred, fold, strategy)


def parse_cell_name(name: str | Column, tracks: Sequence[str] = TRACKS, strategies: Sequence[str] = STRATEGIES) -> list[Column]:
    """Track, seq_len, pred_len, fold, strategy of a run name; NULLs for any other name."""
    c = _col(name)
    one_of = lambda words: "(" + "|".join(map(re.escape, words)) + ")"
    pattern = rf"^(?:bench/)?{one_of(tracks)}_seq(\d+)_pred(\d+)_f(\d+)_{one_of(strategies)}$"
    part = lambda i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    return [part(1).alias("track"), part(2).cast("int").alias("seq_len"),
            part(3).cast("int").alias("pred_len"), part(4).cast("int").alias("fold"),
            part(5).alias("strategy")]


def input_length(seq_len: str | Column, cadence_min: int = 5) -> Column:
    """The span of an input: whole days as ``7-day``, else hours to six digits as ``6-hour``."""
    minutes = (_col(seq_len) * cadence_min).cast("long")
    six = F.format_string("%.5e", minutes / 60).cast("double").cast("decimal(30,10)").cast("string")
    hours = F.regexp_replace(six, r"(\.0*|(\.\d*[1-9])0+)$", "$2")
    whole_days = minutes % 1440 == 0
    return F.when(whole_days, F.concat((minutes / 1440).cast("long").cast("string"), F.lit("-day"))).otherwise(
        F.concat(hours, F.lit("-hour")))


def score_cell(mean: str | Column, defined: str | Column, grid: str | Column) -> Column:
    """A mean to three digits, followed by (runs with a value / runs of the grid) where these differ.

    A model without rows has NULL for ``defined`` and shows ``--`` alone.
    """
    shown = F.when(_col(mean).isNull(), "--").otherwise(F.format_string("%.3f", _col(mean)))
    share = F.concat_ws("", F.lit(" ("), F.concat_ws("/", _col(defined).cast("string"), _col(grid).cast("string")), F.lit(")"))
    complete = F.coalesce(_col(defined) == _col(grid), F.lit(True))
    return F.concat(shown, F.when(complete, "").otherwise(share))
