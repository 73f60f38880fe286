"""Half-open interval tables: building, checking, and labelling samples with them.

An interval table has ``start_ts``, ``end_ts`` (NULL while open) and attribute columns. A table of one
timeline (a designation table) is small and ordered as a whole. Tables of many timelines take their key as ``by``, and
``slice_seconds`` for timelines of any length: their ordered steps then run in slices of the start, with
one border row per slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxlake.operators.ordered import beside, in_ranges, range_slices, running_sum, same_keys, time_slice
from fluxlake.session import materialize

# Fixed values of the designation tables.
OPEN = "open"
UNKNOWN = "unknown"
NONE = "none"
VALID_SATS = [str(n) for n in range(8, 20)]
DESIGNATION_COLUMNS = ["start_utc", "end_utc", "instrument", "primary_sat", "secondary_sat",
                       "source", "source_url", "retrieved_utc"]


def parse_utc(text: str | Column) -> Column:
    """ISO text that must end in ``Z``; NULL otherwise."""
    col = F.col(text) if isinstance(text, str) else text
    return F.when(col.endswith("Z"), F.try_to_timestamp(col))


def start_slices(slice_seconds: int, start: str | Column = "start_ts") -> Column:
    """Slices of the start; rows without one come first."""
    at = F.unix_micros(F.col(start) if isinstance(start, str) else start)
    return F.coalesce(F.floor(at / F.lit(slice_seconds * 1_000_000)).cast("long"), F.lit(-2**62))


def _neighbours(df: DataFrame, by: tuple[str, ...], order: list[str], columns: list[str], slice_seconds: int | None) -> DataFrame:
    """``df`` with ``_before`` and ``_after``, the columns of the neighbouring rows in a timeline."""
    if slice_seconds is not None:
        return beside(df, list(by), order, columns, start_slices(slice_seconds, order[0]))
    along, row = Window.partitionBy(*by).orderBy(*order), F.struct(*columns)
    return df.withColumns({"_before": F.lag(row).over(along), "_after": F.lead(row).over(along)})


def interval_ends(starts: DataFrame, final_end: Column, start: str = "start_ts", by: tuple[str, ...] = (),
                  slice_seconds: int | None = None) -> DataFrame:
    """End of each interval = start of the next of its key; the last end is given."""
    known = _neighbours(starts, by, [start], [start], slice_seconds)
    return known.withColumn("end_ts", F.coalesce(F.col("_after")[start], final_end)).drop("_before", "_after")


def merge_equal(intervals: DataFrame, attrs: list[str], by: tuple[str, ...] = (), slice_seconds: int | None = None) -> DataFrame:
    """Join up contiguous intervals of a key with equal attributes."""
    known = _neighbours(intervals.select(*by, "start_ts", "end_ts", *attrs), by, ["start_ts"], ["end_ts", *attrs], slice_seconds)
    same = F.col("_before.end_ts").eqNullSafe(F.col("start_ts"))
    for a in attrs:
        same = same & F.col("_before")[a].eqNullSafe(F.col(a))
    flagged = known.withColumn("_new", F.when(same, 0).otherwise(1)).drop("_before", "_after")
    if slice_seconds is None:
        upto = Window.partitionBy(*by).orderBy("start_ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        tagged = flagged.withColumn("_part", F.sum("_new").over(upto))
    else:
        tagged = running_sum(flagged, list(by), ["start_ts"], "_new", "_part", start_slices(slice_seconds))
    return tagged.groupBy("_part", *by, *attrs).agg(
        F.min("start_ts").alias("start_ts"),
        F.max_by("end_ts", "start_ts").alias("end_ts")).drop("_part")


def fill_unknown(cited: DataFrame, global_start: Column, current_start: Column, attrs: list[str],
                 fill: str = UNKNOWN) -> DataFrame:
    """Cited intervals plus ``unknown`` rows for every span in ``[global_start, current_start)``
    they leave uncovered. An overlap or an interval out of bounds is an error."""
    order = Window.orderBy("start_ts")
    before = F.coalesce(F.lag("end_ts").over(order), global_start)
    bad = ((F.col("start_ts") < global_start) | (F.col("end_ts") > current_start)
           | (F.col("end_ts") <= F.col("start_ts")) | (before > F.col("start_ts")))
    checked = cited.withColumn("_before", before).withColumn(
        "start_ts", F.when(bad, F.raise_error(F.lit("interval overlaps or is out of bounds")))
        .otherwise(F.col("start_ts")))
    gaps = (checked.filter(F.col("_before") < F.col("start_ts"))
            .select(F.col("_before").alias("start_ts"), F.col("start_ts").alias("end_ts"),
                    *[F.lit(fill).alias(a) for a in attrs]))
    tail = (checked.agg(F.max("end_ts").alias("_end"))
            .select(F.coalesce("_end", global_start).alias("start_ts"),
                    current_start.alias("end_ts"), *[F.lit(fill).alias(a) for a in attrs])
            .filter(F.col("start_ts") < F.col("end_ts")))
    kept = checked.select("start_ts", "end_ts", *attrs)
    return kept.unionByName(gaps).unionByName(tail)


def fill_unknown_by(cited: DataFrame, bounds: DataFrame, attrs: list[str], by: tuple[str, ...],
                    slice_seconds: int, fill: str = UNKNOWN) -> DataFrame:
    """As :func:`fill_unknown` for many timelines of any length.

    ``bounds`` has ``by``, ``global_start`` and ``current_start``, a row per key; a key without cited intervals is
    ``unknown`` from end to end, and intervals of other keys are left out.
    """
    known = _neighbours(cited.select(*by, "start_ts", "end_ts", *attrs), by, ["start_ts"], ["end_ts"], slice_seconds)
    limits = bounds.select(*[F.col(k).alias(f"_of_{k}") for k in by], "global_start", "current_start")
    met = limits.join(known, same_keys(known, limits, list(by), "_of_"), "left").select(
        *[F.col(f"_of_{k}").alias(k) for k in by], "global_start", "current_start", "start_ts", "end_ts", *attrs,
        F.coalesce("_before.end_ts", "global_start").alias("_from"))
    bad = ((F.col("start_ts") < F.col("global_start")) | (F.col("end_ts") > F.col("current_start"))
           | (F.col("end_ts") <= F.col("start_ts")) | (F.col("_from") > F.col("start_ts")))
    checked = met.filter("start_ts IS NOT NULL").withColumn("start_ts", F.when(bad, F.raise_error(F.lit(
        "interval overlaps or is out of bounds"))).otherwise(F.col("start_ts")))
    unknown = [F.lit(fill).alias(a) for a in attrs]
    gaps = checked.filter(F.col("_from") < F.col("start_ts")).select(
        *by, F.col("_from").alias("start_ts"), F.col("start_ts").alias("end_ts"), *unknown)
    tails = met.groupBy(*by, "global_start", "current_start").agg(F.max("end_ts").alias("_end")).select(
        *by, F.coalesce("_end", "global_start").alias("start_ts"), F.col("current_start").alias("end_ts"), *unknown)
    return checked.select(*by, "start_ts", "end_ts", *attrs).unionByName(gaps).unionByName(
        tails.filter(F.col("start_ts") < F.col("end_ts")))


def violations(table: DataFrame, by: tuple[str, ...] = (), slice_seconds: int | None = None) -> DataFrame:
    """Every rule a designation table (text columns) breaks: ``by``, ``start_utc``, ``problem``.

    With ``by`` each key has a timeline of its own.
    """
    table = _neighbours(table.withColumn("_start", parse_utc("start_utc")), by, ["_start", "start_utc", "end_utc"],
                        ["start_utc"], slice_seconds)
    start, is_open = parse_utc("start_utc"), F.col("end_utc") == OPEN
    end = F.when(~is_open, parse_utc("end_utc"))
    last = F.col("_after.start_utc").isNull()
    nxt = parse_utc(F.col("_after.start_utc"))
    sat_ok = F.col("primary_sat").isin([*VALID_SATS, UNKNOWN])
    second_ok = F.col("secondary_sat").isin([*VALID_SATS, UNKNOWN, NONE])
    rules = {
        "instrument must be proton": F.col("instrument") != "proton",
        "invalid primary satellite": ~sat_ok,
        "invalid secondary satellite": ~second_ok,
        "bad start time": start.isNull(),
        "bad end time": ~is_open & end.isNull(),
        "open end before the last row": is_open & ~last,
        "end is not after start": end <= start,
        "not contiguous with the next row": ~last & ~is_open & (end != nxt),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text))
                               for text, bad in rules.items()]), lambda x: x.isNotNull())
    return (table.withColumn("_problems", found)
            .select(*by, "start_utc", F.explode("_problems").alias("problem")))


def validate(table: DataFrame) -> DataFrame:
    """The table itself, or an error that names the first violations."""
    if table.isEmpty():
        raise ValueError("no rows")
    found = violations(table).limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{v.start_utc}: {v.problem}" for v in found))
    return table


def to_intervals(table: DataFrame) -> DataFrame:
    """Typed intervals of the proton rows of a designation table."""
    return (
        table.filter(F.col("instrument") == "proton")
        .select(parse_utc("start_utc").alias("start_ts"),
                F.when(F.col("end_utc") != OPEN, parse_utc("end_utc")).alias("end_ts"),
                F.col("primary_sat").cast("string").alias("primary_sat"),
                F.col("secondary_sat").cast("string").alias("secondary_sat"))
    )


def label_asof(samples: DataFrame, intervals: DataFrame, attrs: list[str],
               time: str = "time_utc", slice_seconds: int = 86_400, by: tuple[str, ...] = ()) -> DataFrame:
    """Backward as-of join with a timeline: attributes of the latest interval that started at or before a sample.

    For two large tables take :func:`asof_join`. With ``by``, samples only meet intervals of their own key, and intervals are ordered per key; without,
    all intervals are one timeline (a designation table). Interval ends play no part, as in any as-of join. Each interval is listed under the time
    slices in which it is in force, and samples look up their own slice with an equi-join plus a
    range test. A short list of intervals is broadcast by its measured size; a longer one shuffles
    by slice, where AQE splits a hot slice.
    """
    width = slice_seconds * 1_000_000
    sliced = samples.withColumn("_slice", time_slice(time, width))
    lo, hi = sliced.agg(F.min("_slice"), F.max("_slice")).first()
    until = F.lead("start_ts").over(Window.partitionBy(*by).orderBy("start_ts"))
    spans = intervals.select("start_ts", until.alias("_until"), *by, *attrs)
    first = F.greatest(time_slice("start_ts", width), F.lit(lo))
    last = F.least(F.coalesce(time_slice("_until", width), F.lit(hi)), F.lit(hi))
    in_force = (spans.withColumn("_first", first).withColumn("_last", last)
                .filter(F.col("_first") <= F.col("_last"))
                .withColumn("_slice", F.explode(F.sequence("_first", "_last")))
                .drop("_first", "_last"))
    side = in_force
    hit = (F.col(time) >= side["start_ts"]) & (side["_until"].isNull()
                                               | (F.col(time) < side["_until"]))
    for key in by:
        hit = hit & (sliced[key] == side[key])
    return (sliced.join(side, (sliced["_slice"] == side["_slice"]) & hit, "left")
            .select(*[sliced[c] for c in samples.columns], *[side[a] for a in attrs]))


RANGE_ROWS = 500_000


def range_count(df: DataFrame, rows: int) -> int | None:
    """So many ranges that each holds about ``rows`` rows however long the table is; None for one shorter than that."""
    n = df.count()
    return max(-(-n // rows), df.sparkSession.sparkContext.defaultParallelism) if n > rows else None


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, attrs: list[str],
              range_rows: int = RANGE_ROWS) -> DataFrame:
    """Backward as-of join of two tables of any size: ``left`` with the ``attrs`` of its key's latest row in ``right``.

    Rows of both sides are put into one order and cut into ranges of about equal size, ties included; a range has
    about ``range_rows`` rows, so what a task sorts does not grow with the tables. The last row of ``right`` is carried
    through each range, and from range to range in one row per range border inside a key. Of rows
    of ``right`` at one time the one with the largest attributes counts. A row without key or time meets nothing.
    """
    clash = set(left.columns) & set(attrs)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    own, found = F.struct(*left.columns), F.struct(*attrs)
    kinds = {"_own": left.select(own.alias("x")).schema["x"].dataType, "_found": right.select(found.alias("x")).schema["x"].dataType}
    keyed = right.filter(F.col(right_time).isNotNull()).dropna(subset=by) if by else right.filter(F.col(right_time).isNotNull())
    both = left.select(
        *by, F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(kinds["_found"]).alias("_found"),
        F.xxhash64(*left.columns).alias("_salt"), own.alias("_own"),
    ).unionAll(keyed.select(
        *by, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), found.alias("_found"), F.lit(0).cast("long").alias("_salt"),
        F.lit(None).cast(kinds["_own"]).alias("_own")))
    n, on = range_count(both, range_rows), [*by, "_slice"]
    sliced = in_ranges(both, [*by, "_time", "_side", "_found", "_salt"], n)
    spread = sliced.repartition(n, *on) if n else sliced
    order = Window.partitionBy(*on).orderBy("_time", "_side", "_found")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # rows of ``left``, and the last row of each key and range
    met = materialize(spread.select(
        *on, "_side", "_own", F.last("_found", ignorenulls=True).over(upto).alias("_met"),
        F.lead(F.lit(True)).over(order).isNull().alias("_end")).filter("_side = 1 OR _end"), "asof")
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # only a key that is cut by a range border has something to carry: fewer rows than ranges
    carried = materialize(met.filter("_end").select(
        *[F.col(c).alias(f"_on_{c}") for c in on], F.last("_met", ignorenulls=True).over(earlier).alias("_carry")).filter(
        "_carry IS NOT NULL"), "carried")
    own = met.filter("_side = 1")
    known = own.join(carried, same_keys(own, carried, on, "_on_"), "left").withColumn("_met", F.coalesce("_met", "_carry"))
    timed = F.col("_own")[left_time].isNotNull()
    return known.select(*[F.col("_own")[c].alias(c) for c in left.columns],
                        *[F.when(timed, F.col("_met")[a]).alias(a) for a in attrs])


def assign_roles(samples: DataFrame, intervals: DataFrame | None, time: str = "time_utc",
                 series: str = "series", sat: str = "source_sat") -> DataFrame:
    """Add ``role``: from the series name where it says so, else from the intervals in force."""
    persat = F.col(series).rlike("^G[0-9]{1,2}$")
    if intervals is None:
        labelled, found = samples, F.lit("undesignated")
    else:
        labelled = label_asof(samples, intervals, ["primary_sat", "secondary_sat"], time)
        number = F.col(sat).cast("string")
        found = (F.when(number == F.col("primary_sat"), "primary")
                 .when(number == F.col("secondary_sat"), "secondary").otherwise("other"))
    role = (F.when(F.col(series) == "Gp", "primary").when(F.col(series) == "Gs", "secondary")
            .when(persat, found))
    return labelled.withColumn("role", role).drop("primary_sat", "secondary_sat")


def relabel(grid_rows: DataFrame, intervals: DataFrame, era_start: str, eras: tuple[str, str],
            time: str = "time_utc", series: str = "series", sat: str = "source_sat") -> DataFrame:
    """Satellite, era and role of every grid row, those without a sample included.

    A series of one satellite names it; the era changes at ``era_start``; roles come from the intervals.
    """
    named = F.nullif(F.regexp_extract(series, "^G([0-9]{1,2})$", 1), F.lit("")).cast("int")
    labelled = grid_rows.withColumn(sat, F.coalesce(named, F.col(sat))).withColumn(
        "era", F.when(F.col(time) < F.lit(era_start).cast("timestamp"), eras[0]).otherwise(eras[1]))
    return assign_roles(labelled, intervals, time, series, sat)


PAIRS = 1 << 18


def _swept_pairs(begin: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) with ``begin[i] <= j < stop[i]``, about PAIRS at a time."""
    before = np.concatenate(([0], np.cumsum(stop - begin)))
    at = 0
    while at < before[-1]:
        upto = min(at + PAIRS, int(before[-1]))
        place = np.arange(at, upto)
        i = np.searchsorted(before, place, "right") - 1
        yield i, begin[i] + place - before[i]
        at = upto


def _ordered_pairs(one: pa.Array, two: pa.Array, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of different names, the smaller one left."""
    less, more = pc.less(one, two), pc.greater(one, two)
    apart = pc.or_(less, more)
    batch = pa.RecordBatch.from_arrays(
        [pc.if_else(less, one, two), pc.if_else(less, two, one), pa.array(low), pa.array(high)],
        names=["left_name", "right_name", "overlap_start", "overlap_end"])
    yield batch.filter(apart)


def overlapping_spans(spans: DataFrame, name: str, start: str, end: str) -> DataFrame:
    """Pairs of spans of different names that overlap, with the common stretch.

    A sweep over ranges of the starts: a range holds about equally many spans, and those still open at its first
    start are carried into it. In a range the spans that start while another is open are a run of the sorted
    starts, so the work is that of sorting and of the pairs themselves (spans of one name, which give no pair, are taken
    not to overlap each other much). A span is carried only into ranges in which it meets a start.
    """
    known = spans.filter(F.col(start) < F.col(end)).select(
        F.unix_micros(start).alias("a"), F.unix_micros(end).alias("z"), F.col(name).alias("name"))
    sliced = range_slices(known, ["a", "z", "name"])
    # one number per range, as many as the session has shuffle partitions
    firsts = sorted((r["_slice"], r["first"]) for r in sliced.groupBy("_slice").agg(F.min("a").alias("first")).collect())
    slices, starts = np.array([s for s, _ in firsts], np.int64), np.array([f for _, f in firsts], np.int64)

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.searchsorted(slices, batch.column("_slice").to_numpy())
            # ranges after its own whose first start comes before the span ends
            times = np.maximum(np.searchsorted(starts, batch.column("z").to_numpy(), "left") - place, 1)
            row = np.repeat(np.arange(len(times)), times)
            step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            copies = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(slices[place[row] + step]), pa.array(step == 0), *(copies.column(c) for c in ("a", "z", "name"))],
                names=["_slice", "_own", "a", "z", "name"])

    kind = sliced.schema["name"].dataType
    long = T.LongType()
    copied = T.StructType([T.StructField("_slice", long), T.StructField("_own", T.BooleanType()), T.StructField("a", long),
                           T.StructField("z", long), T.StructField("name", kind)])
    pairs = T.StructType([T.StructField("left_name", kind), T.StructField("right_name", kind),
                          T.StructField("overlap_start", long), T.StructField("overlap_end", long)])
    # spans in order, those carried into the range first
    held = sliced.mapInArrow(carried, copied).groupBy("_slice").agg(
        F.sort_array(F.collect_list(F.struct("_own", "a", "z", "name"))).alias("spans"))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column("spans"):
                own, a, z, names = (group.values.field(i) for i in range(4))
                a, z = a.to_numpy(), z.to_numpy()
                n_carried = int(np.searchsorted(own.to_numpy(zero_copy_only=False), True))
                # what a span meets begins behind it, or with the range's first start
                begin = np.maximum(np.arange(len(a)) + 1, n_carried)
                stop = np.maximum(n_carried + np.searchsorted(a[n_carried:], z, "left"), begin)
                for left, right in _swept_pairs(begin, stop):
                    hi = np.minimum(z[left], z[right])
                    one, two = names.take(pa.array(left)), names.take(pa.array(right))
                    yield from _ordered_pairs(one, two, a[right], hi)

    found = held.select("spans").mapInArrow(met, pairs)
    return found.withColumns({c: F.timestamp_micros(c) for c in ("overlap_start", "overlap_end")})
