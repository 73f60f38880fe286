"""Exact medians of groups that are too large to hold their values in one task.

A quantile sketch per group (mergeable, a few kilobytes) brackets the middle ranks within a known rank error. The
brackets are written before values meet them, so that their size is known and Spark may broadcast them; as an
aggregation over a few groups they would be merge-joined, with a whole group sorted in one task. A second pass counts
the values below the bracket and the distinct values inside it, both combined on the map side. A bracket of more than
``ORDERED`` distinct values is cut at ``CUTS`` quantiles of these, so in steps of about equally many however they
cluster; counts per step tell which one or two hold the middle ranks, and the others are dropped, round by round until
what is left is short enough to be ordered in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxlake.operators.ordered import same_keys
from fluxlake.session import materialize

ACCURACY = 10_000
ORDERED = 1_000_000
CUTS = 256


def _ranks() -> tuple[Column, Column]:
    return F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)


def longest(inside: DataFrame, keys: list[str]) -> int:
    """Distinct values in the longest bracket."""
    return inside.groupBy(*keys, "name").count().agg(F.max("count")).first()[0] or 0


def narrowed(inside: DataFrame, keys: list[str], cuts: int = CUTS) -> DataFrame:
    """One round: of steps of about equally many distinct values, those that hold the middle ranks.

    ``inside`` has a row per distinct value ``v`` with its count ``_c``, and ``_before`` for the count below them all.
    """
    own = [*keys, "name"]
    at = materialize(inside.groupBy(*own).agg(
        F.percentile_approx("v", [i / cuts for i in range(1, cuts)], ACCURACY).alias("_cuts")).select(
        *[F.col(k).alias(f"_of_{k}") for k in own], "_cuts"), "cuts")
    stepped = inside.join(at, same_keys(inside, at, own, "_of_")).select(
        *inside.columns, F.size(F.filter("_cuts", lambda c: c < F.col("v"))).alias("_step"))
    along = Window.partitionBy(*own).orderBy("_step")
    sums = stepped.groupBy(*own, "n", "_step").agg(F.sum("_c").alias("_s"), F.max("_before").alias("_base")).withColumn(
        "_upto", F.col("_base") + F.sum("_s").over(along))
    low, high = _ranks()
    holds = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - F.col("_s") <= rank)
    wanted = materialize(sums.filter(holds(low) | holds(high)).select(
        *[F.col(k).alias(f"_of_{k}") for k in own], F.col("_step").alias("_of_step"),
        # steps between the two have no values, so the lower one's count serves both
        F.min(F.col("_upto") - F.col("_s")).over(Window.partitionBy(*own)).alias("_start")), "steps")
    match = same_keys(stepped, wanted, own, "_of_") & (F.col("_step") == F.col("_of_step"))
    return stepped.join(wanted, match).select(
        *[c for c in inside.columns if c != "_before"], F.col("_start").alias("_before"))


def grouped_medians(df: DataFrame, keys: list[str], values: list[str], accuracy: int = ACCURACY,
                    ordered: int = ORDERED) -> DataFrame:
    """``keys`` and the exact median of each value column; NULLs do not count.

    As a plain median, the mean of the two middle values for an even count. All columns share both
    passes.
    """
    data = df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values])
    margin = 4.0 / accuracy
    probs = [0.5 - margin, 0.5 + margin]
    sketch = data.groupBy(*keys).agg(*[F.struct(
        F.count(v).alias("n"), F.percentile_approx(v, probs, accuracy).alias("q")).alias(f"_{v}")
        for v in values])
    # a row per group: written, its size is known before the join, which then neither shuffles nor sorts the values
    bounds = materialize(sketch, "bounds").alias("r")
    same_key = F.lit(True)
    for k in keys:
        same_key = same_key & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    items = F.array(*[F.struct(
        F.lit(v).alias("name"), F.col(f"r._{v}.n").alias("n"), F.col(f"r._{v}.q")[0].alias("lo"),
        F.col(f"r._{v}.q")[1].alias("hi"), F.col(f"l.{v}").alias("v")) for v in values])
    tall = (data.alias("l").join(bounds, same_key)
            .select(*[F.col(f"r.{k}").alias(k) for k in keys], F.explode(items).alias("_i"))
            .select(*keys, "_i.*"))
    counted = materialize(
        tall.filter(F.col("v") <= F.col("hi"))
        .groupBy(*keys, "name", "n", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v"))
        .agg(F.count("*").alias("_c")), "bracket")
    own = [*keys, "name"]
    below = counted.filter("v IS NULL").select(*[F.col(k).alias(f"_of_{k}") for k in own], F.col("_c").alias("_before"))
    found = counted.filter("v IS NOT NULL")
    inside = found.join(below, same_keys(found, below, own, "_of_"), "left").select(
        *found.columns, F.coalesce("_before", F.lit(0)).alias("_before"))
    size = longest(found, keys)
    while size > ordered:
        inside = materialize(narrowed(inside, keys), "bracket")
        size = longest(inside, keys)
    upto = Window.partitionBy(*own).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = inside.withColumn("_end", F.col("_before") + F.sum("_c").over(upto))

    def at(rank):
        inside = (F.col("_end") > rank) & (F.col("_end") - F.col("_c") <= rank)
        return F.max(F.when(inside, F.col("v")))

    middle = ranked.groupBy(*keys, "name").agg(
        ((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("m"))
    # the sketch guarantees both ranks lie in the bracket; never return a silent NULL
    checked = F.when(F.col("m").isNull(), F.raise_error(F.lit(
        "median rank outside the sketch bracket"))).otherwise(F.col("m"))
    return middle.withColumn("m", checked).groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == v, F.col("m"))).alias(v) for v in values])


def grouped_median(df: DataFrame, keys: list[str], value: str, out: str = "median",
                   accuracy: int = ACCURACY) -> DataFrame:
    """``keys, out``: the exact median of one value column."""
    return grouped_medians(df, keys, [value], accuracy).withColumnRenamed(value, out)
