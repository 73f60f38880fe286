"""Paired comparison of one model with its rivals: signed-rank test and Holm correction.

With up to ``LISTED`` pairs a rival's null distribution is listed value by value. Beyond that its tail is
a finite Fourier sum: the characteristic function at a frequency is a product of cosines, one per rank, which is far
from zero at few frequencies only. A product over some of the ranks bounds it from above, so tasks first go
through blocks of frequencies with ``BOUND_RANKS`` ranks and keep those that are not negligible for certain; the
products over all ranks at the rest are sums of logarithms, added up by Spark. No rival's ranks are in one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxlake.session import materialize

LISTED = 1000
BOUND_RANKS = 256
FREQUENCIES, CHUNK = 1 << 20, 1 << 13
NEGLIGIBLE = 1e-24


def paired(rows: DataFrame, cell: list[str], metric: str, champion: str) -> DataFrame:
    """Champion and rival values on the same cell: ``cell, rival, champion_value, rival_value``."""
    champ = rows.filter(F.col("model") == champion).select(
        *cell, F.col(metric).alias("champion_value"))
    rivals = rows.filter(F.col("model") != champion).select(
        *cell, F.col("model").alias("rival"), F.col(metric).alias("rival_value"))
    return rivals.join(champ, cell)


@F.pandas_udf(T.DoubleType())
def _upper_tail(ranks2: pd.Series, w2: pd.Series) -> pd.Series:
    """P(W+ >= w) when every rank gets a random sign; ranks are doubled to be whole numbers."""
    out = []
    for ranks, w in zip(ranks2, w2):
        dist = np.ones(1)
        for k in np.asarray(ranks, dtype=int):
            grown = np.zeros(len(dist) + k)
            grown[:len(dist)] += dist / 2
            grown[k:] += dist / 2
            dist = grown
        out.append(float(dist[int(w):].sum()) if len(dist) > int(w) else 0.0)
    return pd.Series(out)


def rank_groups(diffs: DataFrame, key: str) -> DataFrame:
    """``key, rank2, tied, wins``: doubled mean rank, number and positive ones of every size of ``d`` but 0.

    A rival has at most a row per pair here, and the exact test's work grows with the square of the pairs: they are
    ordered per rival.
    """
    sizes = diffs.filter(F.col("d") != 0).groupBy(key, F.abs("d").alias("_size")).agg(
        F.count("*").alias("tied"), F.count_if(F.col("d") > 0).alias("wins"))
    upto = Window.partitionBy(key).orderBy("_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sizes.withColumn("rank2", 2 * F.sum("tied").over(upto) - F.col("tied") + 1).select(key, "rank2", "tied", "wins")


def _not_negligible(m: np.ndarray, ranks: np.ndarray, weights: list[float], enough: float) -> np.ndarray:
    """The frequencies whose weighted squares of turns stay below ``enough``."""
    total = np.zeros(len(m))
    for rank, weight in zip(ranks, weights, strict=True):
        turn = m * rank
        turn -= np.rint(turn)
        turn *= turn
        turn *= weight
        total += turn
        stays = total < enough
        if np.count_nonzero(stays) < 0.9 * len(m):
            m, total = m[stays], total[stays]
            if not len(m):
                break
    return m


def _live_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequencies of a block at which the product over all ranks may be more than negligible.

    ``ln |cos(pi y)| <= -(pi y)^2 / 2`` for y in half a turn. At low frequencies, where no rank reaches a quarter turn, a
    bounding group of ranks stands for its lowest one.
    """
    enough = -2 * math.log(NEGLIGIBLE) / math.pi**2
    for batch in batches:
        for row in batch.to_pylist():
            begin, stop = max(1, row["block"] * FREQUENCIES), min((row["block"] + 1) * FREQUENCIES, (row["period"] - 1) // 2 + 1)
            low = min(max(row["period"] // (2 * row["highest"]) + 1, begin), stop)
            live = [np.empty(0, np.int64)]
            for first, last, rank, weight in ((begin, low, "lowest", "ranks"), (low, stop, "rank", "tied")):
                ranks = np.array([b[rank] for b in row["bounding"]]) / row["period"]
                weights = [float(b[weight]) for b in row["bounding"]]
                for at in range(first, last, CHUNK):
                    live.append(_not_negligible(np.arange(at, min(at + CHUNK, last)), ranks, weights, enough))
            found = np.concatenate(live)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(row["rival"], batch.schema.field("rival").type), len(found)), pa.array(found, pa.int64())], names=["rival", "m"])


def fourier_tail(groups: DataFrame) -> DataFrame:
    """``rival, p_value``: P(W+ >= w) from rank groups, exact but for an absolute error of about 1e-14.

    The ranks' sum S makes W+ a number of 0 … S, so S + 1 frequencies give the tail exactly.
    """
    totals = groups.groupBy("rival").agg(
        F.sum(F.col("rank2") * F.col("tied")).alias("whole"), F.sum(F.col("rank2") * F.col("wins")).alias("w"),
        F.max(F.col("rank2") % 2).alias("odd"), F.count("*").alias("n_groups"))
    # without odd doubled ranks plain ranks do
    unit = F.when(F.col("odd") == 1, 1).otherwise(2)
    totals = totals.select("rival", "n_groups", unit.alias("unit"), F.expr("whole div if(odd = 1, 1, 2) + 1").alias("period"),
                           F.expr("w div if(odd = 1, 1, 2)").alias("w"))
    ranks = groups.join(totals, "rival").select("rival", "period", "n_groups", "tied", F.expr("rank2 div unit").alias("rank"))
    place = F.row_number().over(Window.partitionBy("rival").orderBy("rank"))
    parts = ranks.withColumn("part", F.floor(place * BOUND_RANKS / F.col("n_groups"))).groupBy("rival", "period", "part").agg(
        F.min("rank").alias("lowest"), F.max("rank").alias("top"), F.sum("tied").alias("ranks"),
        # without a pattern, since evenly spaced ranks agree at some frequencies
        F.min_by(F.struct("rank", "tied"), F.xxhash64("rank")).alias("one"))
    bounding = parts.groupBy("rival", "period").agg(
        F.max("top").alias("highest"), F.collect_list(F.struct("lowest", "ranks", "one.rank", "one.tied")).alias("bounding"))
    blocks = bounding.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"period div 2 div {FREQUENCIES}"))))
    spread = blocks.repartition(groups.sparkSession.sparkContext.defaultParallelism, "rival", "block")
    kind = groups.schema["rival"].dataType.simpleString()
    live = materialize(spread.mapInArrow(_live_frequencies, f"rival {kind}, m long"), "frequencies")

    cosine = F.cos(F.pmod(F.col("m") * F.col("rank"), 2 * F.col("period")) * (F.lit(math.pi) / F.col("period")))
    products = live.join(ranks, "rival").groupBy("rival", "m", "period").agg(
        F.sum(F.col("tied") * F.coalesce(F.ln(F.abs(cosine)), F.lit(-1e9))).alias("log_size"),
        F.sum(F.when(cosine < 0, F.col("tied")).otherwise(0)).alias("negative"))
    sign = F.when((F.col("negative") + F.col("m")) % 2 == 0, 1.0).otherwise(-1.0)
    turn = lambda steps: F.pmod(steps, F.col("period")) * (F.lit(2 * math.pi) / F.col("period"))
    term = sign * F.exp("log_size") * F.sin(turn(F.col("m") * F.col("w"))) / F.sin(F.col("m") * F.lit(math.pi) / F.col("period"))
    sums = products.join(totals.select("rival", "w"), "rival").groupBy("rival").agg(F.sum(term).alias("waves"))
    p = (F.col("period") - F.col("w") - F.coalesce("waves", F.lit(0.0))) / F.col("period")
    return totals.join(sums, "rival", "left").select("rival", F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)).alias("p_value"))


def signed_rank(pairs: DataFrame, higher_better: bool = True, listed: int = LISTED) -> DataFrame:
    """One-sided exact signed-rank test per rival that the champion is better.

    Zero differences are dropped and tied sizes share their mean rank. A rival has one pair per benchmark cell; its
    distribution is listed up to ``listed`` pairs and summed by frequencies beyond, where p-values under 1e-14 are not told from 0.
    """
    d = F.col("champion_value") - F.col("rival_value")
    diffs = materialize(pairs.select("rival", (d if higher_better else -d).alias("d")), "pairs")
    median = diffs.groupBy("rival").agg(F.expr("percentile(d, 0.5)").alias("median_diff"))
    groups = rank_groups(diffs, "rival")
    tests = groups.groupBy("rival").agg(
        F.sum("tied").alias("n"), F.sum(F.col("rank2") * F.col("wins")).alias("_w2")).join(median, "rival")
    sizes = tests.select(F.col("rival").alias("_rival"), F.col("n").alias("_n"))
    sized = groups.join(sizes, F.col("rival") == F.col("_rival"))
    lists = sized.filter(F.col("_n") <= listed).groupBy("rival").agg(
        F.flatten(F.collect_list(F.array_repeat("rank2", F.col("tied").cast("int")))).alias("_ranks2"))
    found = tests.filter(F.col("n") <= listed).join(lists, "rival").select("rival", _upper_tail("_ranks2", "_w2").alias("p_value"))
    large = diffs.filter("d != 0").groupBy("rival").count().filter(F.col("count") > listed)
    if not large.isEmpty():
        found = found.unionAll(fourier_tail(sized.filter(F.col("_n") > listed).select(*groups.columns)))
    return tests.join(found, "rival").select("rival", "n", (F.col("_w2") / 2).alias("w_plus"), "median_diff", "p_value")


def holm(tests: DataFrame, p: str = "p_value", out: str = "holm_p") -> DataFrame:
    """Holm-adjusted p-values over all rows (one per rival)."""
    order = Window.orderBy(p, "rival")
    m = F.count("*").over(Window.partitionBy())
    scaled = F.col(p) * (m - F.row_number().over(order) + 1)
    stepped = tests.withColumn("_s", scaled)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stepped.withColumn(out, F.least(F.lit(1.0), F.max("_s").over(upto))).drop("_s")
