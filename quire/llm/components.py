"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.plans.durable import settled


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of the links (u, v).

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step joins the
    links of a node to the smallest neighbour, an aggregate of one row a node, so that no
    neighbourhood is gathered anywhere. Every round is written to the shared folder.
    """
    stars = settled(edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(stars)
    while before[0]:
        both = stars.select("u", "v").unionAll(stars.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = settled(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"),
                                                                    F.col("m").alias("v"))
                        .filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        stars = settled(linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .unionAll(least.select("u", F.col("m").alias("v")))
                        .filter("u <> v").distinct())
        now = _mark(stars)
        if now == before:
            break
        before = now
    tops = stars.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(tops)
