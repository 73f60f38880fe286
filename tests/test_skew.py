"""One series holds most of the rows, many of them within a minute; results must be whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxlake.operators import grid
from fluxlake.operators.median import grouped_medians
from fluxlake.operators.ordered import keep_one, previous_time, slice_width, time_slice

ROWS = 30_000


@pytest.fixture(scope="module")
def hot(spark):
    i = F.col("id")
    series = F.when(i < ROWS * 2 // 3, "hot").otherwise(F.concat(F.lit("s"), (i % 7).cast("string")))
    # two thirds of the rows fall into twenty seconds, the rest are spread over days
    at = F.when(i < ROWS * 2 // 3, i * 1000).otherwise(i * 30_000_000)
    return spark.range(ROWS).select(
        series.alias("series"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + at).alias("time_utc"),
        (F.hash("id") % 10_007).cast("double").alias("value"), "id")


def test_slices_stay_small(hot):
    width = slice_width(hot, ["series"], "time_utc", rows=1000)
    largest = hot.groupBy("series", time_slice("time_utc", width).alias("s")).count().agg(F.max("count")).first()[0]
    assert largest <= 3100


def test_previous_time_is_whole(hot):
    width = slice_width(hot, ["series"], "time_utc", rows=1000)
    out = previous_time(hot, ["series"], width_us=width)
    row = out.agg(F.count("*").alias("n"), F.count_if(F.col("prev_time").isNull()).alias("first"),
                  F.count_if(F.col("prev_time") >= F.col("time_utc")).alias("bad")).first()
    assert tuple(row) == (ROWS, 8, 0)


def test_medians_equal_numpy(hot):
    pdf = hot.toPandas()
    got = {r.series: (r.value, r.id) for r in grouped_medians(hot, ["series"], ["value", "id"], 500).collect()}
    for s, g in pdf.groupby("series"):
        assert got[s] == (np.median(g["value"]), np.median(g["id"]))


def test_copies_of_one_key_collapse(hot):
    copies = hot.withColumn("k", F.when(F.col("series") == "hot", "x").otherwise(F.col("id").cast("string")))
    out = keep_one(copies, ["k"], ["id"])
    assert out.count() == 1 + ROWS - ROWS * 2 // 3
    assert out.filter("k = 'x'").first().id == ROWS * 2 // 3 - 1


def test_bins_and_segments_collapse_before_the_shuffle(hot):
    assert grid.bin_mean(hot, 5).agg(F.sum("n_samples")).first()[0] == ROWS
    segs = grid.segments(hot, gap_seconds=3600)
    assert segs.filter("series = 'hot'").count() == 1
    plan = segs._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan


def test_one_hot_instant_is_cut_by_the_tie_break(spark):
    """All rows at one time: slices follow the whole order, so none holds more than its share.

    Partitions this small would be put together again; here they stay apart.
    """
    from fluxlake.operators.ordered import range_slices, row_index

    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    hot = spark.range(8000).select(F.lit("hot").alias("series"), F.timestamp_seconds(F.lit(0)).alias("time_utc"),
                                   ((F.col("id") * 7919) % 8000).alias("id"))
    sizes = [r["count"] for r in range_slices(hot, ["series", "time_utc", "id"]).groupBy("_slice").count().collect()]
    spark.conf.unset(name)
    assert max(sizes) < 8000 * 0.6 and sum(sizes) == 8000
    rows = row_index(hot, ["time_utc", "id"], keys=["series"]).filter("row_idx != id").count()
    assert rows == 0


def test_medians_of_one_large_group_and_of_few_values(spark):
    """The bracket is cut into steps: exact for spread values, for two values and for ties at the middle."""
    from fluxlake.operators.median import grouped_medians

    rows = spark.range(20_001).select(
        F.when(F.col("id") < 20_000, "big").otherwise("one").alias("k"),
        ((F.col("id") * 7919) % 20_000 / 7.0).alias("spread"), (F.col("id") % 2).cast("double").alias("two"),
        F.when(F.col("id") % 3 == 0, F.col("id") / 1e6).otherwise(0.5).alias("tied"))
    got = {r.k: r for r in grouped_medians(rows, ["k"], ["spread", "two", "tied"]).collect()}
    want = {r.k: r for r in rows.groupBy("k").agg(*[F.median(c).alias(c) for c in ("spread", "two", "tied")]).collect()}
    assert got == want


def test_keyed_asof_join_has_no_unpartitioned_window(spark):
    from fluxlake.plans.labelling import asof_by_series

    plan = asof_by_series(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan
