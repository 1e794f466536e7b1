"""Poisson bootstrap over frequency tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from parcelsight.functions import draws
from parcelsight.operators.ordering import value_frequencies


def mean_interval(df: DataFrame, by: Sequence[str], value: str, replicates: int = 200, level: float = 0.95,
                  seed: int = 0) -> DataFrame:
    """Mean per group with the percentile interval of its bootstrap replicates.

    Each replicate weighs every row by a Poisson number of mean 1. The weights of n equal rows add up to one of mean n, so
    one draw serves all rows of a distinct (group, value): the data is read and counted once, and draws and sums follow the
    distinct values, added on the map side to groups times replicates. A draw comes from the hash of seed, group, value
    and replicate: any partitioning and any rerun give the same result. Rows without a group or value are left out; a
    replicate in which no row of a group has weight does not count for it.
    """
    by, tail = list(by), (1.0 - level) / 2.0
    if not by or replicates < 1 or not 0.0 < level < 1.0:
        raise ValueError("a bootstrap asks for group columns, replicates and a level between 0 and 1")
    freq = value_frequencies(df, value, by)
    drawn = freq.withColumn("_replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn(
        "_weight", draws.poisson(draws.uniform(F.lit(seed), *by, value, "_replicate"), "n"))
    means = drawn.groupBy(*by, "_replicate").agg(
        F.sum("_weight").alias("_all"), F.sum(F.col("_weight") * F.col(value)).alias("_sum")).where("_all > 0").select(
        *by, (F.col("_sum") / F.col("_all")).alias("_mean"))
    limits = means.groupBy(*by).agg(F.percentile("_mean", [tail, 1.0 - tail]).alias("_limits"))
    points = freq.groupBy(*by).agg(
        F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col(value).cast("double")) / F.sum("n")).alias("mean"))
    return points.join(limits, by, "left").select(
        *by, F.col("_n").alias("n"), "mean", F.col("_limits")[0].alias("ci_low"), F.col("_limits")[1].alias("ci_high"))
