"""Connected components by alternating large-star and small-star steps.

Links are rows (u, v). A large star connects the larger neighbours of every node with its smallest
neighbour, a small star the smaller ones; both keep connectivity, and their fixed point is one star
around the smallest node of each component. Neighbourhoods are never gathered: a step is one
aggregate (smallest neighbour per node) and one join that adaptive execution splits at hot nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlake.session import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low"))
    low = low.select(F.col("u").alias("node"), F.least("u", "low").alias("low"))
    return (both.filter("v > u").join(low, F.col("u") == F.col("node"))
            .select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u > v").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    low = links.groupBy("u").agg(F.min("v").alias("low")).withColumnRenamed("u", "node")
    turned = links.join(low, F.col("u") == F.col("node")).filter("v != low").select(
        F.col("v").alias("u"), F.col("low").alias("v"))
    return turned.unionAll(low.select(F.col("node").alias("u"), F.col("low").alias("v"))).distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every linked node but the smallest of each component."""
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    links = materialize(links.distinct(), "links")
    mark = _mark(links)
    while mark[0]:
        links = materialize(_small_star(_large_star(links)), "links")
        now = _mark(links)
        if now == mark:
            break
        mark = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
