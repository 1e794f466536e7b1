"""Model frames: what is known at order time, and what is known after delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelsight.functions import expressions as X

# Fixed value: state of the logistics hub.
DEFAULT_HUB = "SP"

# Features known when the order is placed.
ORDER_TIME_FEATURES = [
    "order_item_id", "price", "freight_value", "freight_ratio", "total_price",
    "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm",
    "order_purchase_dayofweek", "order_purchase_month", "expected_delivery_days",
    "main_category", "sub_category", "distance_km", "distance_cat", "cross_state",
    "is_sp_customer", "is_sp_seller", "sp_route_type", "sp_route_type_customer",
    "sp_route_type_seller",
]
# Further features known only after delivery.
AFTER_DELIVERY_ONLY = [
    "approved_days", "dispatch_days", "delivery_days", "delay_days", "is_delayed",
    "delay_days_cat", "delivery_speed", "day_per_km", "delivery_ratio", "delivery_distance",
    "delivery_price",
]
AFTER_DELIVERY_FEATURES = ORDER_TIME_FEATURES + AFTER_DELIVERY_ONLY

# Columns of the analysis table behind each frame.
ORDER_TIME_SOURCE = [
    "order_id", "review_score", "delivery_days", "order_item_id", "price", "freight_value",
    "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm",
    "order_purchase_dayofweek", "order_purchase_month", "expected_delivery_days",
    "main_category", "sub_category", "distance_km", "distance_cat", "cross_state",
    "customer_state", "seller_state",
]
AFTER_DELIVERY_SOURCE = ORDER_TIME_SOURCE + [
    "approved_days", "dispatch_days", "delay_days", "is_delayed", "delay_days_cat"]
MODEL_TABLE_DROPS = ["customer_id", "seller_id", "category", "delay_days_int"]


def positive_label(review_score: str | Column) -> Column:
    """1 for a score of 4 or 5."""
    return (X.col(review_score) >= 4).cast("int")


def three_class_label(review_score: str | Column) -> Column:
    """2 good, 1 middling (exactly 3), 0 bad."""
    s = X.col(review_score)
    return F.when(s >= 4, 2).when(s == 3, 1).when(s.isNotNull(), 0)


def with_price_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "freight_ratio": X.safe_divide("freight_value", "price"),
        "total_price": F.col("price") + F.col("freight_value"),
    })


def with_route_features(df: DataFrame, hub: str = DEFAULT_HUB) -> DataFrame:
    """Whether either end lies in the hub state: 0 neither, 1 one, 2 both.

    The one-sided variants look at their own end first: 1 only that end, 2 both.
    """
    at_customer, at_seller = X.equals_flag("customer_state", hub), X.equals_flag("seller_state", hub)
    return df.withColumns({
        "is_sp_customer": at_customer,
        "is_sp_seller": at_seller,
        "sp_route_type": at_customer + at_seller,
        "sp_route_type_customer": at_customer * (F.lit(1) + at_seller),
        "sp_route_type_seller": at_seller * (F.lit(1) + at_customer),
    })


def with_delivery_features(df: DataFrame) -> DataFrame:
    """Speed, ratio and interaction features that need the real delivery time."""
    return df.withColumns({
        "delivery_speed": X.safe_divide("distance_km", "delivery_days"),
        "day_per_km": X.safe_divide("delivery_days", "distance_km"),
        "delivery_ratio": X.safe_divide("delivery_days", "expected_delivery_days"),
        "delivery_distance": F.col("delivery_days") * F.col("distance_km"),
        "delivery_price": F.col("delivery_days") * F.col("price"),
    })


def with_penalty_features(df: DataFrame) -> DataFrame:
    """Historical interaction features of delay, freight and distance."""
    return df.withColumns({
        "freight_delay_penalty": F.col("freight_value") * F.col("delay_days"),
        "price_delay_penalty": F.col("price") * F.col("delay_days"),
        "total_delay_penalty": (F.col("price") + F.col("freight_value")) * F.col("delay_days"),
        "freight_distance_interaction": F.col("freight_value") * F.col("distance_km"),
        "delivery_freight_cost": F.col("delivery_days") * F.col("freight_value"),
        "is_weekend_purchase": X.is_weekend("order_purchase_dayofweek"),
    })


def _finite(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: X.finite_or_null(c) for c in columns})


def order_time_frame(items: DataFrame, hub: str = DEFAULT_HUB) -> DataFrame:
    """Keys, targets and the 22 order-time features; rows without a target are dropped."""
    derived = with_route_features(with_price_features(items), hub)
    derived = _finite(derived, ["freight_ratio", "total_price"])
    return derived.select("order_id", "review_score", "delivery_days", *ORDER_TIME_FEATURES).na.drop(
        subset=["order_id", "review_score", "delivery_days"])


def model_table(items: DataFrame) -> DataFrame:
    """The analysis table as stored for modelling: fewer keys, whole delay days."""
    return items.drop(*MODEL_TABLE_DROPS).withColumn("delay_days", X.truncate("delay_days"))


def after_delivery_frame(items: DataFrame, hub: str = DEFAULT_HUB) -> DataFrame:
    """Key, target and the 33 post-delivery features."""
    whole = items.withColumn("delay_days", X.truncate("delay_days"))
    derived = with_delivery_features(with_route_features(with_price_features(whole), hub))
    derived = _finite(derived, ["freight_ratio", "total_price", "delivery_speed", "day_per_km",
                                "delivery_ratio", "delivery_distance", "delivery_price"])
    return derived.select("order_id", "review_score", *AFTER_DELIVERY_FEATURES)


def with_overrides(items: DataFrame, **values) -> DataFrame:
    """What-if scenario: replace source columns by literals or expressions.

    Dependent source columns (state difference, distance band) follow suit.
    """
    from parcelsight.functions.bands import distance_band

    as_column = {c: v if isinstance(v, Column) else F.lit(v) for c, v in values.items()}
    out = items.withColumns(as_column)
    if {"customer_state", "seller_state"} & set(values):
        out = out.withColumn("cross_state", X.differs_flag("customer_state", "seller_state"))
    if "distance_km" in values and "distance_cat" not in values:
        out = out.withColumn("distance_cat", distance_band("distance_km"))
    return out
