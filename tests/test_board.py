import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxlake.functions.registry import RUN_KEYS
from fluxlake.operators import board, compare, conditions, significance

KEYS = "track string, seq_len int, pred_len int, fold int, strategy string, model string, "


def reg(spark, rows):
    full = [(t, s, p, f, "direct", m, "c", v) for t, s, p, f, m, v in rows]
    return spark.createDataFrame(full, KEYS + "channel string, rmse double")


def test_cell_means_skip_undefined_and_excluded(spark):
    df = reg(spark, [("t", 288, 36, 0, "a", 1.0), ("t", 288, 36, 1, "a", None), ("t", 2016, 36, 0, "xpatch", 9.0),
                     ("t", 288, 36, 0, "xpatch", 2.0)])
    got = {r.model: (r.rmse, r.rmse_defined, r.n_rows) for r in board.cell_means(df, ["rmse"]).collect()}
    assert got == {"a": (1.0, 1, 2), "xpatch": (2.0, 1, 1)}
    assert [tuple(r) for r in board.left_out(df).collect()] == [(36, 1)]


def test_shortfall(spark):
    df = reg(spark, [("t", 1, 36, 0, "a", 1.0), ("t", 2, 36, 0, "a", 1.0), ("t", 1, 36, 0, "b", 1.0), ("t", 1, 36, 1, "b", 1.0)])
    got = sorted((r.model, r.fold, r.seq_len) for r in board.shortfall(df).collect())
    assert got == [("a", 1, 1), ("b", 0, 2)]


def test_board_order_puts_undefined_last_and_breaks_ties_by_name(spark):
    df = reg(spark, [("t", 1, 36, 0, "b", 1.0), ("t", 1, 36, 0, "a", 1.0), ("t", 1, 36, 0, "z", None), ("t", 1, 36, 0, "c", 0.5)])
    order = board.board(board.cell_means(df, ["rmse"]), {"t": "c"}).orderBy("position").collect()
    assert [r.model for r in order] == ["c", "a", "b", "z"]


def test_merge_masters(spark):
    cols = [*RUN_KEYS, "channel", "rmse"]
    a, b = reg(spark, [("t", 2, 36, 0, "a", 1.0)]), reg(spark, [("t", 1, 36, 0, "a", 2.0)])
    assert [r.seq_len for r in board.merge_masters([a, b], cols, [*RUN_KEYS, "channel"]).collect()] == [1, 2]
    with pytest.raises(ValueError, match="more than once"):
        board.merge_masters([a, a], cols, [*RUN_KEYS, "channel"])
    with pytest.raises(ValueError, match="layout"):
        board.merge_masters([a, b.drop("rmse")], cols, RUN_KEYS)
    with pytest.raises(ValueError):
        board.merge_masters([], cols, RUN_KEYS)


def test_best_first(spark):
    df = reg(spark, [("t", 1, 36, i, "m", v) for i, v in enumerate([2.0, None, 1.0])])
    ranks = {r.fold: r.rank for r in board.best_first(df, "rmse", ["channel"]).collect()}
    assert ranks == {2: 1, 0: 2, 1: 3}


def test_fold_ci_and_quantiles(spark):
    df = reg(spark, [("t", 1, 36, i, "m", float(v)) for i, v in enumerate([1, 2, 4, 5, 8])])
    row = board.fold_ci(df, ["track"], ["rmse"]).first()
    sd = np.std([1, 2, 4, 5, 8], ddof=1)
    assert row.rmse_ci == pytest.approx(2.776445105 * sd / math.sqrt(5))
    assert board.fold_ci(df.limit(1), ["track"], ["rmse"]).first().rmse_ci is None
    q = spark.range(1, 200).select("id", board.t_quantile(F.col("id")).alias("q")).collect()
    q = {r.id: r.q for r in q}
    assert q[31] == pytest.approx(2.0395134, abs=1e-5) and q[120] == pytest.approx(1.9799304, abs=1e-6)
    assert all(q[i] > q[i + 1] for i in range(1, 199))


def test_champions_and_standings(spark):
    df = spark.createDataFrame([("x", "a", 0.9, 0.05), ("x", "b", 0.8, 0.06), ("y", "a", 0.5, 0.01), ("y", "b", 0.7, 0.01)],
                               "cell string, model string, hss double, hss_ci double")
    got = {r.cell: (r.champion, r.runner_up, round(r.gap, 6), r.overlap) for r in board.champions(df, ["cell"], "hss", "hss_ci").collect()}
    assert got == {"x": ("a", "b", 0.1, True), "y": ("b", "a", 0.2, False)}
    assert {r.model: (r.wins, r.avg_rank) for r in board.standings(df, ["cell"], "hss").collect()} == {"a": (1, 1.5), "b": (1, 1.5)}


def pairs(spark, diffs, rival="r"):
    return spark.createDataFrame([(i, rival, float(d), 0.0) for i, d in enumerate(diffs)],
                                 "cell int, rival string, champion_value double, rival_value double")


def brute_p(diffs):
    d = [x for x in diffs if x != 0]
    size = sorted(abs(x) for x in d)
    rank = {s: np.mean([i + 1 for i, v in enumerate(size) if v == s]) for s in size}
    ranks = [rank[abs(x)] for x in d]
    w = sum(r for r, x in zip(ranks, d) if x > 0)
    sums = [sum(r for i, r in enumerate(ranks) if m >> i & 1) for m in range(2 ** len(d))]
    return w, np.mean([s >= w for s in sums])


@pytest.mark.parametrize("diffs", [[1, 2, 3, -4, 5], [1, 1, -1, 2, 0, 3], [-1, -2, -3], [0.5] * 6])
def test_signed_rank_is_exact(spark, diffs):
    row = significance.signed_rank(pairs(spark, diffs)).first()
    w, p = brute_p(diffs)
    assert row.w_plus == pytest.approx(w) and row.p_value == pytest.approx(p)
    assert row.median_diff == pytest.approx(np.median(diffs))


def test_36_wins_give_two_to_the_minus_36(spark):
    row = significance.signed_rank(pairs(spark, range(1, 37))).first()
    assert row.n == 36 and row.p_value == pytest.approx(2.0 ** -36)


def test_holm(spark):
    p = [1.46e-11, 7.28e-11, 3.64e-10, 6.26e-10, 6.26e-10, 4.66e-9, 7.80e-9, 5.42e-8, 2.44e-7]
    df = spark.createDataFrame([(f"r{i}", v) for i, v in enumerate(p)], "rival string, p_value double")
    got = [r.holm_p for r in significance.holm(df).orderBy("rival").collect()]
    assert got[0] == pytest.approx(1.314e-10) and got[-1] == pytest.approx(2.44e-7)
    assert got == sorted(got)


def test_flip_bound(spark):
    counts = spark.createDataFrame([(1, 20, 10, 5, 65)], "k int, tp long, fp long, fn long, tn long")
    row = compare.flip_range(counts, ["k"], ["pod", "far", "hss"], k=5).first()
    assert (row.pod_lo, row.pod_hi) == (pytest.approx(15 / 25), pytest.approx(1.0))
    assert row.far_lo < 10 / 30 < row.far_hi
    ok = counts.select(compare.within(F.lit(15 / 25), F.lit(row.pod_lo), F.lit(row.pod_hi)),
                       compare.within(F.lit(14 / 25), F.lit(row.pod_lo), F.lit(row.pod_hi))).first()
    assert tuple(ok) == (True, False)


@pytest.mark.parametrize("a,b,ok", [(1.0, 1.00009, True), (1.0, 1.0002, False), (None, None, True), (None, 1.0, False),
                                    (math.inf, math.inf, True), (math.inf, 1.0, False), (math.nan, None, True)])
def test_relative_tolerance(spark, a, b, ok):
    df = spark.createDataFrame([(a, b)], "a double, b double")
    assert df.select(compare.relative_ok(F.col("a"), F.col("b"))).first()[0] is ok


def test_conditions(spark):
    grid = conditions.condition_grid(spark, {"track": ["a", "b"], "seq_len": [1, 2], "pred_len": [1], "fold": [0],
                                             "strategy": ["direct", "recursive"]})
    runs = conditions.with_models(grid, {"a|direct": ["m", "n"], "b|direct": ["m"]})
    assert runs.count() == 6
    kept = conditions.without(runs, [("m", 2)], ["model", "seq_len"])
    assert kept.count() == 4
    done, pred = kept.filter("track = 'a'"), kept.filter("model = 'm'")
    left = sorted((r.track, r.model, r.seq_len) for r in conditions.pending(kept, done, pred).collect())
    assert left == [("a", "n", 1), ("a", "n", 2), ("b", "m", 1)]
    with pytest.raises(ValueError):
        conditions.require_scorable(done, pred)
    shards = [conditions.shard(kept, RUN_KEYS, i, 3).count() for i in range(3)]
    assert sum(shards) == 4
    with pytest.raises(ValueError):
        conditions.shard(kept, RUN_KEYS, 3, 3)


def test_formula_check_allows_for_rounding(spark):
    pub = spark.createDataFrame([(1, 2594, 326, 13861, 229313, 0.253, 0.155), (2, 7, 1, 52, 795, 0.196, 0.118),
                                 (3, 0, 0, 0, 9, None, None)],
                                "id int, tp long, fp long, fn long, tn long, pub_hss double, pub_csi double")
    got = {(r.id, r.metric): r.ok for r in compare.formula_check(pub, ["id"], ["hss", "csi"]).collect()}
    assert got == {(1, "hss"): True, (1, "csi"): True, (2, "hss"): True, (2, "csi"): False,
                   (3, "hss"): True, (3, "csi"): True}


@pytest.mark.parametrize("diffs", [[1, 2, 3, -4, 5], [1, 1, -1, 2, 0, 3], [-1, -2, -3], [0.5] * 6, [1, -1, 1, 1, 2, -2, 3, 3, 3, 7]])
def test_frequency_sums_equal_the_listed_distribution(spark, diffs):
    _, p = brute_p(diffs)
    row = significance.signed_rank(pairs(spark, diffs), listed=0).first()
    assert row.p_value == pytest.approx(p, abs=1e-13)


def test_signed_rank_of_twenty_thousand_pairs(spark):
    """No rival has its ranks in a row; the tail is close to the normal limit, and ties change its spread."""
    n = 20_000
    i = F.col("id")
    df = spark.range(n).select(
        i.alias("cell"), F.lit("apart").alias("rival"), F.lit(0.0).alias("rival_value"),
        (F.when(F.pmod(F.xxhash64("id"), F.lit(1000)) < 507, 1).otherwise(-1) * (i + 1)).cast("double").alias("champion_value"))
    tied = df.withColumn("rival", F.lit("tied")).withColumn("champion_value", F.signum("champion_value") * F.ceil((F.col("cell") + 1) / 400))
    for row in significance.signed_rank(df.unionAll(tied)).collect():
        size = np.arange(1, n + 1) if row.rival == "apart" else np.repeat(np.arange(200, n, 400) + 0.5, 400)
        spread = math.sqrt(np.sum(size**2.0)) / 2
        z = (row.w_plus - 0.5 - size.sum() / 2) / spread
        assert row.n == n and row.p_value == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=2e-3)
        assert 1e-8 < row.p_value < 0.3
