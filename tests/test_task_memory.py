"""What one task holds must not follow the size of a group or of the table."""

import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxlake import session
from fluxlake.operators import intervals, median, quality


@pytest.fixture
def plans(monkeypatch):
    """Names and physical plans of the tables that the medians write."""
    seen, write = [], median.materialize

    def noted(df, name):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(median, "materialize", noted)
    return seen


def test_values_meet_their_brackets_without_a_sort(spark, plans):
    """Two groups: merge-joined with their brackets, each one's values would be sorted in one task."""
    rows = spark.range(40_000).select((F.col("id") % 2).alias("k"), ((F.col("id") * 7919) % 40_000 / 7.0).alias("v"))
    got = {r.k: r.v for r in median.grouped_medians(rows, ["k"], ["v"], accuracy=40, ordered=100).collect()}
    assert got == {k: np.median([(i * 7919) % 40_000 / 7.0 for i in range(40_000) if i % 2 == k]) for k in (0, 1)}
    brackets = [p for name, p in plans if name == "bracket"]
    assert len(brackets) > 1  # the first count and rounds of narrowing
    assert all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in brackets)


def test_steps_meet_their_median_without_a_sort(spark):
    """The size of a joined bracket is overestimated; that of a written table of medians is not."""
    rows = spark.range(500).select((F.col("id") % 2).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("t"), "id")
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, "256k")
    out = quality.cadence_report(rows, ["k"], "t", "id", F.floor(F.col("id") / 100).cast("long"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset(name)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [(r.cadence_s, r.n, r.n_gaps, r.coverage) for r in out.collect()] == [(120.0, 250, 0, 1.0)] * 2


@pytest.mark.parametrize("by", [["k"], []])
def test_asof_ranges_follow_the_rows(spark, by):
    """One hot key, many ties, keys without rows on either side, found rows that are empty."""
    rng = random.Random(7)
    key = lambda: rng.choice(["hot"] * 60 + ["a", "b", None])
    left = [(i, key(), rng.choice([rng.randrange(9_000), 4_000, 4_500])) for i in range(6_000)]
    left += [(6_000, "alone", 5), (6_001, "hot", None), (6_002, "hot", -1)]
    # a long stretch without rows on the right is carried over several ranges
    right = [(key(), rng.choice([rng.randrange(3_000), 7_000 + rng.randrange(2_000), 2_999]),
              rng.choice([None, *range(5)])) for _ in range(3_000)] + [("never", 1, 1), ("hot", None, 9), (None, 3, 3)]
    a = spark.createDataFrame(left, "id long, k string, t long").repartition(5)
    b = spark.createDataFrame(right, "k string, since long, v long").repartition(3)
    mark = session.scratch_mark()
    right_side = b if by else b.drop("k")
    out = intervals.asof_join(a, right_side, by, "t", "since", ["since", "v"], range_rows=500)
    got = sorted((r.id, r.since, r.v) for r in out.collect())
    order = {}
    for k, since, v in right:
        if since is not None and (k is not None or not by):
            order.setdefault(k if by else 0, []).append((since, -1 if v is None else v))
    order = {k: sorted(rows) for k, rows in order.items()}
    want = []
    for i, k, t in left:
        rows = order.get(k if by else 0, [])
        n = 0 if t is None else bisect.bisect_right(rows, (t, 10))
        since, v = rows[n - 1] if n else (None, None)
        want.append((i, since, None if v == -1 else v))
    assert got == sorted(want)
    # rows that are found and have nothing but NULL are not taken for missing ones
    alone = intervals.asof_join(a, right_side, by, "t", "since", ["v"], range_rows=500)
    assert sorted(((r.id, r.v) for r in alone.collect()), key=lambda x: x[0]) == [(i, v) for i, _, v in sorted(want, key=lambda x: x[0])]
    # the session has 4 partitions, so ranges as many as these would hold 2,250 rows
    met = next(p for p in session._scratch[mark:] if "fluxlake-asof" in p)
    assert spark.read.parquet(met).groupBy("_slice").count().agg(F.max("count")).first()[0] <= 1_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan


def test_short_asof_tables_are_left_to_the_session(spark):
    rows = spark.range(100)
    assert intervals.range_count(rows, 100) is None
    assert intervals.range_count(rows, 99) == spark.sparkContext.defaultParallelism
    assert intervals.range_count(rows, 3) == 34
