"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelsight.llm.common import Scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component: the smallest id reachable) of every id in ``edges`` (a, b; a null in none).

    Every round points the larger neighbours of a node, then the smaller ones, at its smallest neighbour.
    Minima combine before they are shuffled, so that a hub's edges do not meet in one task. Rounds go on
    until the edges stay as they are, which takes a number that grows with the logarithm of the longest path.
    """
    def star(links: DataFrame, larger: bool) -> DataFrame:
        if larger:
            both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        pointed = both.join(least, "a")
        moved = pointed.filter(F.col("b") > F.col("a") if larger else F.col("b") != F.col("m")).select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        if not larger:
            moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
        return moved.filter("a != b").distinct()

    scratch = Scratch(edges.sparkSession)
    links = scratch.stage(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct(), "links")
    sum_of = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    seen = tuple(links.agg(*sum_of).first())
    while True:
        # each star is staged, so that the driver never plans and compiles one within the other
        links = scratch.stage(star(links, True), "stars")
        links = scratch.stage(star(links, False), "links")
        scratch.release(but=1)
        now = tuple(links.agg(*sum_of).first())
        if now == seen:
            break
        seen = now
    return (links.select(F.col("a").alias("id"), F.col("b").alias("component"))
            .unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct())
