"""Deterministic modes, and filling of missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parcelsight.operators.quantiles import medians


def modes(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per group, ties to the smallest.

    Counts per (group, value) come first, so the state per group is one struct
    and a hot group is already reduced when it is shuffled.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("rank"), F.col(value).alias("value")))
    return counts.groupBy(*by).agg(best.getField("value").alias(value))


def city_point_modes(items: DataFrame, sides: Sequence[str]) -> DataFrame:
    """Modal latitude and longitude of each city, for all sides in one pass.

    Returns ``side, city, lat, lng``. Latitude and longitude are separate modes.
    """
    points = F.explode(F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(f"{side}_city").alias("city"),
                 F.lit(axis).alias("axis"), F.col(f"{side}_{axis}").alias("value"))
        for side in sides for axis in ("lat", "lng")
    ]))
    long = items.select(points.alias("p")).select("p.*").where("city IS NOT NULL")
    best = modes(long, ["side", "city", "axis"], "value")
    pick = lambda axis: F.max(F.when(F.col("axis") == axis, F.col("value"))).alias(axis)
    return best.groupBy("side", "city").agg(pick("lat"), pick("lng"))


def fill_points_by_city(items: DataFrame, sides: Sequence[str],
                        point_modes: DataFrame) -> DataFrame:
    """Fill missing coordinates by their city's mode; without a city they stay missing."""
    out = items
    for side in sides:
        lookup = point_modes.where(F.col("side") == side).select(
            F.col("city").alias(f"{side}_city"), F.col("lat").alias("_lat"),
            F.col("lng").alias("_lng"))
        out = out.join(lookup, f"{side}_city", "left").withColumns({
            f"{side}_lat": F.coalesce(f"{side}_lat", "_lat"),
            f"{side}_lng": F.coalesce(f"{side}_lng", "_lng"),
        }).drop("_lat", "_lng")
    return out


def fill_medians(df: DataFrame, columns: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    """Fill by the exact median of ``source`` (default: the table itself)."""
    values = medians(df if source is None else source, columns)
    packed = df.withColumn("_medians", values.select(F.struct(*columns)).scalar())
    return packed.withColumns({
        c: F.coalesce(F.col(c), F.col(f"_medians.{c}")) for c in columns
    }).drop("_medians")


def fill_constant(df: DataFrame, value, columns: Sequence[str]) -> DataFrame:
    return df.na.fill(value, subset=list(columns))


def sole_or_other(value: str | Column, other: str = "etc") -> Column:
    """Aggregate: the only value of the group, or a collective label."""
    return F.when(F.count("*") == 1, F.min(value)).otherwise(F.lit(other))
