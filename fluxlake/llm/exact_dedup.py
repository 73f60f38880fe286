"""Exact deduplication by distributed most-significant-digit radix partitioning.

Texts are equal when they agree after all white space is deleted. Documents start in one group.
Each round splits every group by the next bytes of the text (and by whether the text ends there);
groups of one document and groups whose texts have ended are done, the others go on with the
rest of their bytes. Strides grow by a constant factor, so a text of n bytes takes log(n) rounds,
and only documents that still share all bytes so far carry their rest along. Equality is decided
by the bytes themselves.

A group is counted with map-side aggregation: a group of copies that holds a third of all rows
reaches the counting tasks as one row per map task. Documents then learn about their group in a
left join whose hot keys adaptive execution splits. Each round is written to the shared folder,
so a lost executor costs one round at most.

Cases: null text is empty, and all empty texts are equal; of equal texts the one with most code
points in the original, then the smallest doc_id stays (a missing id is the largest). Rows that
repeat both id and text share a result, both ``kept``, and :func:`drop_copies` passes one of them
on. An id that repeats with another text is another document. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlake.llm.common import SPACES, whole_text
from fluxlake.session import materialize

FIRST_BYTES = 64
GROWTH = 8


def _split(active: DataFrame, stride: int) -> DataFrame:
    """One radix step: group by the next ``stride`` bytes, then hand every document its group."""
    dealt = active.withColumns({
        "head": F.expr(f"substring(rest, 1, {stride})"),
        "ended": F.octet_length("rest") <= stride,
    })
    # groups are numbered and written, so that a number stays: equal bytes so far, and nothing else, share one
    groups = materialize(
        dealt.groupBy("part", "head", "ended")
        .agg(F.count("*").alias("n"),
             F.min(F.struct((-F.col("n_chars")).alias("chars"), F.col("doc_id").isNull(), F.col("doc_id"))).alias("best"))
        .filter("n > 1")
        .select(F.col("part").alias("g_part"), F.col("head").alias("g_head"), F.col("ended").alias("g_ended"), "n",
                F.monotonically_increasing_id().alias("number"),
                F.col("best.doc_id").alias("best_id"), (-F.col("best.chars")).alias("best_chars")), "groups")
    # the same join at every size: a hot group is split, and few groups are not sent to every task
    met = dealt.join(
        groups.hint("merge"),
        (F.col("part") == F.col("g_part")) & (F.col("head") == F.col("g_head")) & (F.col("ended") == F.col("g_ended")), "left")
    alone, going_on = F.col("n").isNull(), F.col("n").isNotNull() & ~F.col("ended")
    return met.select(
        "doc_id", "n_chars", "text_sha256",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("best_chars", "n_chars").alias("keep_chars"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        going_on.alias("going_on"),
        F.when(going_on, F.col("number")).alias("part"),
        F.when(going_on, F.expr(f"substring(rest, {stride + 1})")).alias("rest"),
    )


def _plain() -> Column:
    """The bytes that decide equality."""
    return F.translate(whole_text(), SPACES, "").cast("binary")


def exact_groups(docs: DataFrame, first_bytes: int = FIRST_BYTES, growth: int = GROWTH) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chars."""
    active = docs.select(
        "doc_id", F.length(whole_text()).alias("n_chars"), F.lit(0).cast("long").alias("part"), _plain().alias("rest"), F.sha2(_plain(), 256).alias("text_sha256"))
    done, stride = [], first_bytes
    while True:
        step = materialize(_split(active, stride), "radix")
        done.append(step.filter("NOT going_on"))
        active = step.filter("going_on").select("doc_id", "n_chars", "part", "rest", "text_sha256")
        if active.isEmpty():
            break
        stride *= growth
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    return reduce(DataFrame.unionAll, done).select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", F.col("n_chars").cast("long"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with the columns of ``docs``.

    Rows are matched by id, digest and length, since ids may repeat or be missing.
    """
    kept = exact_groups(docs).filter("kept").select(
        F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"), F.col("n_chars").alias("kept_chars"))
    # the columns of docs in one, so that no name of theirs meets one of these
    marked = docs.select(
        F.col("doc_id").alias("id"), F.sha2(_plain(), 256).alias("sha"), F.length(whole_text()).alias("chars"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    stays = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")) & (F.col("chars") == F.col("kept_chars"))
    # the join has dealt the rows by these columns already
    return marked.join(kept, stays, "left_semi").dropDuplicates(["id", "sha"]).select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns])
