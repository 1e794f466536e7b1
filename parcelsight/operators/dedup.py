"""De-duplication as aggregation.

Every operator here is a grouped aggregate and not a ranked window: partial
aggregation on the map side reduces a hot key to one row per task, while a
window would bring all its rows to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The last answered review of each order.

    A missing answer time counts as latest; equal times fall back to the
    highest review id.
    """
    recency = F.struct(
        F.col("review_answer_timestamp").isNull(), F.col("review_answer_timestamp"),
        F.col("review_id"))
    chosen = F.max_by(F.struct("review_id", "review_score", "review_answer_timestamp"), recency)
    return reviews.groupBy("order_id").agg(chosen.alias("_r")).select("order_id", "_r.*")


def best_row(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order (ascending, nulls first)."""
    names = [f"_o{i}" for i in range(len(order))]
    ranked = df.withColumn("_row", F.struct(*df.columns)).withColumn(
        "_order", F.struct(*[o.alias(n) for o, n in zip(order, names)]))
    return (ranked.groupBy(key).agg(F.min_by("_row", "_order").alias("_row"))
            .select("_row.*"))


def collapse_orders(items: DataFrame, columns: Sequence[str],
                    required: Sequence[str] = ()) -> DataFrame:
    """One row per order over columns that are constant within an order.

    Constant columns make "first" and "smallest" the same, and the minimum of
    primitive columns stays in hash aggregation.
    """
    needed = ["order_id", *required]
    rows = items.select("order_id", *columns).na.drop(subset=needed)
    return rows.groupBy("order_id").agg(*[F.min(c).alias(c) for c in columns])


def rounded_zip_points(geolocation: DataFrame) -> DataFrame:
    """One point per zip: coordinates to two places, largest latitude then longitude."""
    places = lambda c: F.rint(F.col(c) * 100.0) / 100.0
    rounded = geolocation.select(
        "geolocation_zip_code_prefix",
        F.struct(places("geolocation_lat").alias("lat"), places("geolocation_lng").alias("lng"),
                 F.col("geolocation_city").alias("city")).alias("point"))
    return rounded.groupBy("geolocation_zip_code_prefix").agg(F.max("point").alias("point")).select(
        "geolocation_zip_code_prefix", F.col("point.lat").alias("geolocation_lat"),
        F.col("point.lng").alias("geolocation_lng"), F.col("point.city").alias("geolocation_city"))
