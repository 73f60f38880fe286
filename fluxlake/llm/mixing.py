"""Mixing sources to target weights by a time-varying curriculum.

Targets: each source weighs in by rank, all share ``percent`` of the words, and no source gives
more than ``cap`` times its words; the level at which the rest share the excess is the largest of
the levels that follow from capping the sources in order of words per weight.

Order: a source's documents form a stream in the order of a seeded hash, repeated until the target is
met; the document at the end is taken in part. A source's weight over training time is a
piecewise-linear schedule; its integral is the share of the target demanded so far, and inverting it
gives every document its position in [0, 1]. Documents are range-sorted by position.

The offsets in a stream are prefix sums in 4096 hash slices per source, with one carried row per slice:
a source with a third of all rows is never ordered as a whole. The table of sources is the only
one that meets in one task: a row per source.

Cases: null text has no words and is never taken; a null source is a source, ranked last; rows
that repeat count each. Empty tables give empty results. Other columns pass through
:func:`mix_documents` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxlake.llm.common import WORD, whole_text

WEIGHTS = (3, 1, 2)
PERCENT = 150
CAP = 2
# weights at equally spaced knots of training time, by rank of the source
SHAPES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
SEED = "mix"
SLICE_DIGITS = 3
KEY = ("__mix_no_source", "__mix_source", "__mix_slice")


def n_words(text: str | Column = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def _narrow(docs: DataFrame, *more: Column) -> DataFrame:
    """What the plan needs of a document, under the plan's own names; a missing id is told apart by the text."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(whole_text().cast("binary")))
    code = F.md5(F.concat(F.lit(f"{SEED}:"), own).cast("binary"))
    return docs.select(
        F.col("doc_id").alias("__mix_id"), n_words().alias("__mix_size"), code.alias("__mix_code"),
        F.col("source").isNull().alias("__mix_no_source"), F.coalesce("source", F.lit("")).alias("__mix_source"), *more,
    ).withColumn("__mix_slice", F.substring("__mix_code", 1, SLICE_DIGITS))


def source_targets(slices: DataFrame, weights: tuple, percent: int, cap: int) -> DataFrame:
    """no_source, source, source_size, rank, target from (source, slice, words) rows."""
    sums = slices.groupBy("__mix_no_source", "__mix_source").agg(F.sum("words").alias("source_size"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.orderBy("__mix_no_source", "__mix_source")) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1)
    ranked = ranked.withColumn("weight", weight)
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    level = (F.lit(percent / 100) * F.sum("source_size").over(everything)
             - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
             ) / F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    levelled = ranked.withColumn("level", level)
    levelled = levelled.withColumn("level", F.max("level").over(everything))
    target = F.least(F.lit(float(cap)) * F.col("source_size"), F.col("level") * F.col("weight"))
    return levelled.select("__mix_no_source", "__mix_source", "source_size", "rank", target.alias("target"))


def _position(share: Column, rank: Column, shapes: tuple) -> Column:
    """Training time at which a source has met ``share`` of its demand: the inverse of the integral."""
    step = 1 / (len(shapes[0]) - 1)
    areas = [[step * (a + b) / 2 for a, b in zip(s, s[1:], strict=False)] for s in shapes]
    before = [[sum(a[:k]) / sum(a) for k in range(len(a))] for a in areas]
    pick = lambda table: F.element_at(
        F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in table]), rank % len(shapes) + 1)
    total = F.element_at(F.array(*[F.lit(float(sum(a))) for a in areas]), rank % len(shapes) + 1)
    segment = F.size(F.filter(pick(before), lambda x: x <= share))
    low, high = F.element_at(pick(shapes), segment), F.element_at(pick(shapes), segment + 1)
    rest = (share - F.element_at(pick(before), segment)) * total
    inside = 2 * rest / (low + F.sqrt(F.greatest(low * low + 2 * (high - low) * rest / step, F.lit(0.0))))
    return (segment - 1) * step + inside


def planned(rows: DataFrame, weights: tuple = WEIGHTS, percent: int = PERCENT, cap: int = CAP,
            shapes: tuple = SHAPES) -> DataFrame:
    """Narrow rows with source_size, target, taken and, per pass, (pass, words, position)."""
    slices = rows.groupBy(*KEY).agg(F.sum("__mix_size").alias("words"))
    targets = source_targets(slices, weights, percent, cap)
    earlier = Window.partitionBy(*KEY[:2]).orderBy(KEY[2]).rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(*KEY, F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("words_before"))
    carried = carried.join(targets, list(KEY[:2])).select(
        *KEY, F.col("words_before").alias("__mix_before"), F.col("source_size").alias("__mix_total"),
        F.col("rank").alias("__mix_rank"), F.col("target").alias("__mix_target"))
    inside = Window.partitionBy(*KEY).orderBy("__mix_code", "__mix_id", "__mix_size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("__mix_inside", F.coalesce(F.sum("__mix_size").over(inside), F.lit(0))).join(carried, list(KEY))
    at = F.col("__mix_before") + F.col("__mix_inside")
    out = out.withColumns({"__mix_at": at, "__mix_goal": F.floor(F.col("__mix_target") + 0.5)})
    # words of pass k: the part of [k * total + at, + size) below the goal
    passes = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda k: F.struct(
        k.alias("pass"),
        F.greatest(F.least(F.col("__mix_goal") - k * F.col("__mix_total") - F.col("__mix_at"), F.col("__mix_size")),
                   F.lit(0).cast("long")).alias("words"),
        F.when(F.col("__mix_goal") > 0, (k * F.col("__mix_total") + F.col("__mix_at")) / F.col("__mix_goal")).alias("share")))
    out = out.withColumn("__mix_passes", F.filter(passes, lambda p: p["words"] > 0))
    return out.withColumn("__mix_passes", F.transform("__mix_passes", lambda p: F.struct(
        p["pass"].alias("pass"), p["words"].alias("words"),
        _position(p["share"], F.col("__mix_rank"), shapes).alias("position"))))


def _range_sorted(rows: DataFrame, position: Column) -> DataFrame:
    """Rows in training order, in as many ranges as the session has shuffle partitions; those without a place last."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [position.asc_nulls_last(), F.col("__mix_id").asc_nulls_last()]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def mix_plan(docs: DataFrame) -> DataFrame:
    """One row per document, range-sorted by its first position: doc_id, size, source_size, target, taken, n_passes,
    position of the first and the last pass."""
    place = lambda k: F.round(F.try_element_at(F.col("__mix_passes.position"), F.lit(k)), 9)
    rows = _range_sorted(planned(_narrow(docs)), place(1))
    return rows.select(
        F.col("__mix_id").alias("doc_id"), F.col("__mix_size").alias("size"), F.col("__mix_total").alias("source_size"),
        F.col("__mix_target").alias("target"),
        F.aggregate("__mix_passes", F.lit(0).cast("long"), lambda a, p: a + p["words"]).alias("taken"),
        F.size("__mix_passes").alias("n_passes"), place(1).alias("position"), place(-1).alias("last_position"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: a row of ``docs`` for each pass, range-sorted by position.

    A document that the mix takes in part is passed on whole.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__mix_row")
    rows = planned(_narrow(docs, row)).withColumn("__mix_pass", F.explode("__mix_passes"))
    rows = _range_sorted(rows, F.col("__mix_pass.position"))
    return rows.select(*[F.col("__mix_row").getField(c).alias(c) for c in docs.columns])
